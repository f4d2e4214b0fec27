"""Row and column splices on cells and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shifted(v: Column, start: int, count: int, inserts: int) -> Column:
    """Where a line lies after a splice; a line within the deleted span clamps to its start."""
    return F.when(v < start, v).when(v >= start + count, v + (inserts - count)).otherwise(F.lit(start))


def splice(cells: DataFrame, axis: str, start: int, count: int, inserts: DataFrame | None = None, n_inserts: int = 0) -> DataFrame:
    """Delete ``count`` lines from ``start`` and insert ``n_inserts``; ``inserts`` are cells numbered from 1 on the axis.
    Inserted columns reach only rows that exist."""
    out = cells.where(~F.col(axis).between(start, start + count - 1)).withColumn(axis, shifted(F.col(axis), start, count, n_inserts).cast("int"))
    if inserts is not None:
        new = inserts.withColumn(axis, (F.col(axis) + (start - 1)).cast("int"))
        if axis == "col":
            new = new.join(cells.select("row").distinct(), "row", "left_semi")
        out = out.unionByName(new, allowMissingColumns=True)
    return out


def append_rows(cells: DataFrame, rows: DataFrame, last: int) -> DataFrame:
    """Rows numbered from 1 go below row ``last``."""
    return cells.unionByName(rows.withColumn("row", (F.col("row") + last).cast("int")), allowMissingColumns=True)


def duplicate_row(cells: DataFrame, start: int, count: int, insert: bool = True) -> DataFrame:
    copies = cells.where(F.col("row") == start).withColumn("row", F.explode(F.sequence(F.lit(start + 1), F.lit(start + count))))
    rest = cells.withColumn("row", F.when(F.col("row") > start, F.col("row") + count).otherwise(F.col("row")).cast("int")) if insert else cells.where(~F.col("row").between(start + 1, start + count))
    return rest.unionByName(copies)


def splice_merges(merges: DataFrame, axis: str, start: int, count: int, n_inserts: int = 0) -> DataFrame:
    """Rectangles shift; those wholly deleted go, edges in the span clamp, open edges stay."""
    low, high = ("top", "bottom") if axis == "row" else ("left", "right")
    gone = (F.col(low) >= start) & (F.col(high) < start + count)
    moved = merges.where(~F.coalesce(gone, F.lit(False)))
    end = F.when(F.col(high).between(start, start + count - 1), F.lit(start - 1 + n_inserts)).otherwise(shifted(F.col(high), start, count, n_inserts))
    return moved.withColumn(low, shifted(F.col(low), start, count, n_inserts).cast("int")).withColumn(high, end.cast("int")).where(F.col(high).isNull() | (F.col(high) >= F.col(low)))


def merge_cells(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """Covered cells but the master lose their values."""
    covered = F.col("row").between(top, bottom) & F.col("col").between(left, right) & ~((F.col("row") == top) & (F.col("col") == left))
    blank = [F.when(covered, F.lit("null") if c == "kind" else F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("kind", "num", "str", "bool", "ts", "err", "formula") else F.col(c) for c in cells.columns]
    return cells.select(*blank)


def sort_rows(df: DataFrame, keys: list[Column], row: str = "row") -> DataFrame:
    """Extension: a stable sort as new row numbers (rows keep their order within equal keys)."""
    return df.withColumn("new_row", F.row_number().over(W.orderBy(*keys, row)))
