"""Outline levels of rows or columns: the deepest level, and which summary lines stand collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deepest(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, max_level; a line without a level has level 0."""
    return lines.groupBy(*keys).agg(F.max(F.coalesce("outline_level", F.lit(0))).alias("max_level"))


def collapsed(lines: DataFrame, keys: list[str], line: str = "row", summary_after: bool = True) -> DataFrame:
    """Adds ``is_collapsed``: the unbroken run of deeper lines beside a line (before it, or after it if the summary comes first)
    is not empty and wholly hidden. A missing line has level 0 and breaks a run. Every level above a line's own opens one
    run, so runs are islands by (sheet, level), found in one pass and joined to the line they adjoin; levels are few."""
    level = F.coalesce(F.col("outline_level"), F.lit(0))
    deep = lines.where(level > 0).select(*keys, F.col(line).alias("__n"), F.coalesce("hidden", F.lit(False)).alias("__h"), F.explode(F.sequence(F.lit(0), level - 1)).alias("__l"))
    island = F.col("__n") - F.row_number().over(W.partitionBy(*keys, "__l").orderBy("__n"))
    runs = deep.withColumn("__i", island).groupBy(*keys, "__l", "__i").agg(F.min("__n").alias("__a"), F.max("__n").alias("__z"), F.min("__h").alias("__all"))
    beside = (F.col("__z") + 1) if summary_after else (F.col("__a") - 1)
    found = runs.where("__all").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__l").cast("int").alias("__l"), beside.alias("__at"))
    on = (F.col(line) == F.col("__at")) & (level == F.col("__l"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return lines.join(found, on, "left").withColumn("is_collapsed", F.col("__at").isNotNull()).drop("__l", "__at", *[f"__k_{k}" for k in keys])
