"""CSV files as cells, and cells as CSV text, under exact typing rules.

Quotes toggle literal mode anywhere in a field, ``""`` within quotes is a quote, rows end on LF, an unquoted
CR is dropped, an unterminated quote runs to the end, and a trailing newline adds no row. Quoted newlines make
a file unsplittable, so a file is one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError
from gridlake.functions import values
from gridlake.session import ship_package


def split_rows(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    special = re.compile(f'["\r\n{re.escape(delimiter)}]')
    row: list[str] = []
    field: list[str] = []
    at, quoted, started, size = 0, False, False, len(text)
    while at < size:
        if quoted:
            end = text.find('"', at)
            if end < 0:
                field.append(text[at:])
                break
            field.append(text[at:end])
            if text[end + 1 : end + 2] == '"':
                field.append('"')
                at = end + 2
            else:
                quoted, at = False, end + 1
            continue
        m = special.search(text, at)
        end = m.start() if m else size
        if end > at:
            field.append(text[at:end])
        if not m:
            break
        at, c = end + 1, m[0]
        started = True
        if c == '"':
            quoted = True
        elif c == delimiter:
            row.append("".join(field))
            field = []
        elif c == "\n":
            row.append("".join(field))
            yield row
            row, field, started = [], [], False
    if row or field or started:
        row.append("".join(field))
        yield row


def read(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, infer: bool = True) -> DataFrame:
    """Cells of CSV files: workbook, row, col, kind, num, str, ts. ``header`` drops the first line; without
    ``infer`` every field that is not empty stays text."""
    if len(delimiter) != 1:
        raise AuthoringError("the delimiter is one character")
    ship_package(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("workbook"), F.col("value"))

    def fields(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, text in zip(p["workbook"], p["value"]):
                held: list[tuple] = []
                for i, row in enumerate(split_rows(text.removeprefix("\ufeff"), delimiter)):
                    if header and i == 0:
                        continue
                    n = i + (0 if header else 1)
                    held += [(name, n, j + 1, v) for j, v in enumerate(row)]
                    if len(held) > 20_000:
                        yield pd.DataFrame(held, columns=["workbook", "row", "col", "field"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["workbook", "row", "col", "field"])

    cells = files.mapInPandas(fields, "workbook string, row int, col int, field string").where(F.col("field") != "")
    if not infer:
        return cells.select("workbook", "row", "col", F.lit("string").alias("kind"), F.lit(None).cast("double").alias("num"), F.col("field").alias("str"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return cells.select("workbook", "row", "col", values.csv_value(F.col("field")).alias("v")).select("workbook", "row", "col", "v.kind", "v.num", "v.str", "v.ts")


def quoted(field: Column, delimiter: str = ",") -> Column:
    need = field.contains(delimiter) | field.rlike('["\r\n]')
    return F.when(need, F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(field)


def lines(cells: DataFrame, text: Column | None = None, delimiter: str = ",", by: list[str] | None = None) -> DataFrame:
    """row and line of each row that exists; a row is padded to its own last cell only. A row's cells are one sheet row's, at most 16384."""
    t = text if text is not None else values.value_text(F.col("kind"), F.col("num"), F.col("str"), F.lit(None).cast("boolean"), F.col("ts"), F.lit(None).cast("string"))
    by = by or []
    rows = cells.select(*by, "row", "col", quoted(t, delimiter).alias("t")).groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "t"))).alias("m"), F.max("col").alias("w"))
    return rows.select(*by, "row", F.array_join(F.transform(F.sequence(F.lit(1), F.col("w")), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(""))), delimiter).alias("line"))


def write(cells: DataFrame, path: str, delimiter: str = ",") -> None:
    """Text files of the lines in row order (range-partitioned, so the parts follow each other)."""
    lines(cells, delimiter=delimiter).orderBy("row").select("line").write.mode("overwrite").text(path)
