"""Pivot tables: the cache (dictionaries, records, summaries) and the aggregation with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError

#: metric: caption word. Fixed values.
METRICS = {"sum": "Sum", "count": "Count", "countNums": "Count", "average": "Average", "max": "Max", "min": "Min", "product": "Product", "stdDev": "StdDev", "stdDevp": "StdDevp", "var": "Var", "varp": "Varp"}


def metric(name: str, value: Column, numeric: bool = True) -> Column:
    """The aggregate of a metric. Numeric metrics see finite numbers only; statistics of too few values are null."""
    if name not in METRICS:
        raise AuthoringError(f"unknown metric {name!r}")
    num = F.when(~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf")), value.cast("double")) if numeric else F.lit(None).cast("double")
    return {
        "sum": F.sum(num), "count": F.count(value), "countNums": F.count(num), "average": F.avg(num), "max": F.max(num), "min": F.min(num), "product": F.product(num),
        "stdDev": F.stddev_samp(num), "stdDevp": F.stddev_pop(num), "var": F.var_samp(num), "varp": F.var_pop(num),
    }[name]


def caption(name: str, field: str) -> str:
    return f"{METRICS.get(name, 'Sum')} of {field}"


def _checked(df: DataFrame, rows: list[str], columns: list[str], value: str, name: str) -> None:
    if not rows or not columns:
        raise AuthoringError("a pivot needs a row field and a column field")
    if absent := [c for c in [*rows, *columns, value] if c not in df.columns]:
        raise AuthoringError(f"no such field: {', '.join(absent)}")
    if name not in METRICS:
        raise AuthoringError(f"unknown metric {name!r}")


def pivot_long(df: DataFrame, rows: list[str], columns: list[str], value: str, name: str = "sum", totals: bool = False) -> DataFrame:
    """A row for each pair of row and column items; with totals also the margins and the grand total, told by
    total_level (bit 1: over columns, bit 2: over rows)."""
    _checked(df, rows, columns, value, name)
    numeric = df.schema[value].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")
    agg = metric(name, F.col(value), numeric).alias("value")
    if not totals:
        return df.groupBy(*rows, *columns).agg(agg)
    keys = [*rows, *columns]
    sets = [keys, rows, columns, []]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    over_rows, over_cols = F.grouping(rows[0]), F.grouping(columns[0])
    return g.agg(agg, (over_cols + over_rows * 2).cast("int").alias("total_level"))


def pivot_wide(df: DataFrame, rows: list[str], column: str, value: str, name: str = "sum", items: list | None = None) -> DataFrame:
    """One column for each item of the column field, in the dictionary's order; pass the items to spare the job that finds them."""
    _checked(df, rows, [column], value, name)
    return df.groupBy(*rows).pivot(column, items).agg(metric(name, F.col(value)))


def dictionary(df: DataFrame, field: str, order: str) -> DataFrame:
    """index, item, kind: distinct values in order of first appearance; blank is an item."""
    kind = F.when(F.col(field).isNull(), "blank").otherwise(F.lit(df.schema[field].dataType.typeName()))
    first = df.select(kind.alias("kind"), F.col(field).alias("item"), F.col(order).alias("__o")).groupBy("kind", "item").agg(F.min("__o").alias("first"))
    return first.withColumn("index", F.row_number().over(W.orderBy("first")) - 1)  # as many rows as there are items


def records(df: DataFrame, field: str, order: str) -> DataFrame:
    """The table with the field's dictionary index in place of its values."""
    d = dictionary(df, field, order).select(F.col("item").alias("__i"), "index")
    return df.join(d, F.col(field).eqNullSafe(F.col("__i"))).drop("__i").withColumnRenamed("index", f"{field}_index")


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """A row a field, in one pass over the table: min, max and whether all are whole for numeric fields that hold a
    number (null for the others), and whether blanks occur."""
    kinds = dict(df.dtypes)
    found = []
    for i, f in enumerate(fields):
        number = kinds[f] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[f].startswith("decimal")
        x = F.col(f).cast("double") if number else F.lit(None).cast("double")
        found += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.bool_and(x == F.floor(x)).alias(f"c{i}"), (F.count_if(F.col(f).isNull()) > 0).alias(f"d{i}")]
    each = [F.struct(F.lit(f).alias("field"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"c{i}").alias("all_integer"), F.col(f"d{i}").alias("contains_blank")) for i, f in enumerate(fields)]
    return df.agg(*found).select(F.explode(F.array(*each)).alias("x")).select("x.*")
