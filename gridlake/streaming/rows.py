"""Rows one at a time, in order, with bounded memory; and, as an extension, files that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def iterate(cells: DataFrame) -> Iterator[tuple[int, dict[int, object]]]:
    """(row number, cells by column) in ascending order; blank cells are left out. One partition is held at a time."""
    value = F.coalesce(F.col("str"), F.col("num").cast("string"), F.col("bool").cast("string"), F.col("ts").cast("string"))
    held = cells.where(F.col("kind") != "null").select("row", "col", "num", value.alias("v")).orderBy("row", "col")
    for row, cs in groupby(held.toLocalIterator(), key=lambda r: r["row"]):
        yield row, {c["col"]: c["num"] if c["num"] is not None else c["v"] for c in cs}


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: a stream of text lines of files that come to a folder."""
    return spark.readStream.text(folder)
