"""Projections and extents of a sheet: points, rows, columns, rectangles, used range, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(cells: DataFrame, row: int, col: int, merges: DataFrame | None = None) -> DataFrame:
    if merges is not None:
        at = merges.where(F.lit(row).between(F.col("top"), F.col("bottom")) & F.lit(col).between(F.col("left"), F.col("right"))).select("top", "left").limit(1)
        return cells.join(F.broadcast(at), (F.col("row") == F.col("top")) & (F.col("col") == F.col("left"))).drop("top", "left").unionByName(cells.where((F.col("row") == row) & (F.col("col") == col)).join(F.broadcast(at), F.lit(True), "left_anti"))
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def rectangle(cells: DataFrame, top: int | None = None, left: int | None = None, bottom: int | None = None, right: int | None = None) -> DataFrame:
    """Cells in a rectangle; an absent bound is open."""
    for name, low, high in (("row", top, bottom), ("col", left, right)):
        if low is not None:
            cells = cells.where(F.col(name) >= low)
        if high is not None:
            cells = cells.where(F.col(name) <= high)
    return cells


def used_extent(cells: DataFrame, row_props: DataFrame | None = None, merges: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """row_count, actual_row_count, column_count: last used row and column, rows that hold a value."""
    by = by or []
    held = F.col("kind") != "null"
    out = cells.groupBy(*by).agg(
        F.coalesce(F.max(F.when(held, F.col("row"))), F.lit(0)).cast("long").alias("row_count"),
        F.countDistinct(F.when(held, F.col("row"))).alias("actual_row_count"),
        F.coalesce(F.max(F.when(held, F.col("col"))), F.lit(0)).cast("long").alias("column_count"),
    )
    for other, r, c in ((row_props, "row", None), (merges, "bottom", "right")):
        if other is not None and by:
            more = other.groupBy(*by).agg(F.max(r).cast("long").alias("__r"), (F.max(c) if c else F.lit(None)).cast("long").alias("__c"))
            out = out.join(more, by, "full").withColumn("row_count", F.greatest("row_count", "__r")).withColumn("column_count", F.coalesce(F.greatest("column_count", "__c"), F.lit(0))).drop("__r", "__c")
            out = out.withColumn("actual_row_count", F.coalesce("actual_row_count", F.lit(0)))
        elif other is not None:
            more = other.agg(F.max(r).cast("long").alias("__r"), (F.max(c) if c else F.lit(None)).cast("long").alias("__c"))
            out = out.join(F.broadcast(more)).withColumn("row_count", F.greatest("row_count", "__r")).withColumn("column_count", F.greatest("column_count", "__c")).drop("__r", "__c")
    return out


def tight_box(cells: DataFrame) -> DataFrame:
    """top, left, bottom, right of what is rendered; all null for an empty sheet."""
    return cells.agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))


def all_rows(cells: DataFrame, row_props: DataFrame) -> DataFrame:
    """Numbers of rows with cells or properties."""
    return cells.select("row").unionByName(row_props.select("row")).distinct()


def resolve_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Adds master_row and master_col. Rectangles are cut to their rows' buckets, so the join is on keys, not on ranges;
    merges never overlap, so a cell meets at most one."""
    size = 1024
    cut = merges.select("top", "left", "bottom", "right", F.explode(F.sequence(F.floor(F.col("top") / size), F.floor(F.col("bottom") / size))).alias("__b"))
    inside = (F.floor(F.col("row") / size) == F.col("__b")) & F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    j = cells.join(cut, inside, "left")
    return j.withColumn("master_row", F.coalesce("top", "row")).withColumn("master_col", F.coalesce("left", "col")).drop("top", "left", "bottom", "right", "__b")
