"""Table totals rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError

#: totals function: SUBTOTAL code (10x: rows hidden by hand do not count). Fixed values.
SUBTOTAL = {"average": 101, "countNums": 102, "count": 103, "max": 104, "min": 105, "stdDev": 107, "sum": 109, "var": 110}


def subtotal_formula(function: str, table: str, column: str) -> str:
    if function not in SUBTOTAL:
        raise AuthoringError(f"no totals function {function!r}")
    escaped = "".join("'" + c if c in "[]#'" else c for c in column)
    return f"SUBTOTAL({SUBTOTAL[function]},{table}[{escaped}])"


def totals_row(df: DataFrame, functions: dict[str, str], labels: dict[str, str] | None = None, hidden: str | None = None) -> DataFrame:
    """One row: each column's totals function over the visible rows, or its label."""
    rows = df.where(~F.col(hidden)) if hidden else df
    out = []
    for c, f in functions.items():
        x = F.col(c)
        agg = {"average": F.avg(x), "countNums": F.count(x.try_cast("double")), "count": F.count(x), "max": F.max(x), "min": F.min(x), "stdDev": F.stddev_samp(x), "sum": F.sum(x), "var": F.var_samp(x)}
        if f not in agg:
            raise AuthoringError(f"no totals function {f!r}")
        out.append(agg[f].alias(c))
    return rows.agg(*out, *[F.lit(v).alias(c) for c, v in (labels or {}).items()])


def disambiguate(names: list[str]) -> list[str]:
    """Column names made distinct regardless of case: a later one gets the smallest free number from 2."""
    taken, out = {n.lower() for n in names}, []
    seen: set[str] = set()
    for n in names:
        if n.lower() not in seen:
            seen.add(n.lower())
            out.append(n)
            continue
        k = 2
        while f"{n}{k}".lower() in taken | seen:
            k += 1
        seen.add(f"{n}{k}".lower())
        out.append(f"{n}{k}")
    return out
