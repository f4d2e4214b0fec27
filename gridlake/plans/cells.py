"""Between wide tables and the canonical long form of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.tables import disambiguate

_NUM = ("double", "float", "integer", "long", "short", "byte", "decimal")


def from_table(df: DataFrame, row: str, columns: list[str] | None = None, first_col: int = 1) -> DataFrame:
    """Cells of a wide table of which ``row`` numbers the rows; no shuffle, one generator."""
    cols = columns or [c for c in df.columns if c != row]
    out = []
    for i, c in enumerate(cols):
        t, x = df.schema[c].dataType.typeName(), F.col(c)
        pick = lambda on, y, as_: (y if on else F.lit(None)).cast(as_)
        kind = "number" if t in _NUM else "boolean" if t == "boolean" else "date" if t in ("date", "timestamp", "timestamp_ntz") else "string"
        out.append(F.struct(
            F.lit(first_col + i).alias("col"), F.when(x.isNull(), "null").otherwise(kind).alias("kind"), pick(kind == "number", x, "double").alias("num"), pick(kind == "string", x, "string").alias("str"),
            pick(kind == "boolean", x, "boolean").alias("bool"), pick(kind == "date", x, "timestamp_ntz").alias("ts"),
        ))
    return df.select(F.col(row).cast("int").alias("row"), F.explode(F.array(*out)).alias("c")).select("row", "c.*")


def to_table(cells: DataFrame, names: list[str], first_col: int = 1, header_row: int | None = None) -> DataFrame:
    """A wide text table: a column for each name, by position; one aggregation on the row number."""
    body = cells.where(F.col("row") > header_row) if header_row else cells
    value = F.coalesce(F.col("str"), F.col("num").cast("string"), F.col("bool").cast("string"), F.col("ts").cast("string"))
    return body.groupBy("row").agg(*[F.max(F.when(F.col("col") == first_col + i, value)).alias(n) for i, n in enumerate(disambiguate(names))])
