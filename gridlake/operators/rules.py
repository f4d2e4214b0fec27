"""Column filters, validation rules and conditional formats, executed as predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError

_NUMERIC = ("double", "float", "integer", "long", "short", "byte", "decimal")


def values_filter(c: Column, values: list[str], blank: bool = False) -> Column:
    """Text is one of the values, regardless of case; blanks only if asked for."""
    text = F.lower(c.cast("string"))
    is_blank = c.isNull() | (text == "")
    hit = text.isin([v.lower() for v in values]) if values else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | (is_blank if blank else F.lit(False))


def wildcard(pattern: str) -> str:
    """``*`` any run, ``?`` one character, ``~`` takes the next literally."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "~" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if ch == "*" else "." if ch == "?" else re.escape(ch)
        i += 1
    return rf"(?is)^{out}\z"


def predicate(c: Column, operator: str, operand: str, numeric: bool) -> Column:
    try:
        number = float(operand)
    except ValueError:
        number = None
    if number is not None and numeric:
        x, y = c.cast("double"), F.lit(number)
    else:
        x, y = F.lower(c.cast("string")), F.lit(operand.lower())
        if operator in ("equal", "notEqual"):
            hit = F.coalesce(c.cast("string").rlike(wildcard(operand)), F.lit(False))
            return hit if operator == "equal" else ~hit
    ops = {"equal": x == y, "notEqual": x != y, "lessThan": x < y, "lessThanOrEqual": x <= y, "greaterThan": x > y, "greaterThanOrEqual": x >= y}
    if operator not in ops:
        raise AuthoringError(f"unknown operator {operator!r}")
    return F.coalesce(ops[operator], F.lit(operator == "notEqual"))


def custom_filter(df: DataFrame, column: str, predicates: list[tuple[str, str]], both: bool = False) -> Column:
    if not 1 <= len(predicates) <= 2:
        raise AuthoringError("a custom filter has one or two predicates")
    numeric = df.schema[column].dataType.typeName() in _NUMERIC
    ps = [predicate(F.col(column), op, v, numeric) for op, v in predicates]
    return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), ps)


def autofilter(df: DataFrame, criteria: list[Column]) -> DataFrame:
    """Rows that meet the criteria of all filtered columns."""
    return df.where(reduce(lambda a, b: a & b, criteria, F.lit(True)))


def compare(x: Column, operator: str, one: Column, two: Column | None = None) -> Column:
    """The eight comparisons of validations and cell rules; ``between`` is inclusive, in either order."""
    if operator in ("between", "notBetween"):
        inside = x.between(F.least(one, two), F.greatest(one, two))
        return inside if operator == "between" else ~inside
    ops = {"equal": x == one, "notEqual": x != one, "greaterThan": x > one, "lessThan": x < one, "greaterThanOrEqual": x >= one, "lessThanOrEqual": x <= one}
    if operator not in ops:
        raise AuthoringError(f"unknown operator {operator!r}")
    return ops[operator]


def validation_passes(kind: Column, num: Column, text: Column, type_: str, operator: str = "between", operands: list | None = None, allow_blank: bool = True) -> Column:
    """Whether a cell meets a rule of type whole, decimal, date, time, textLength or list."""
    operands = operands or []
    blank = (kind == "null") | kind.isNull()
    a = F.lit(operands[0]) if operands else F.lit(None)
    b = F.lit(operands[1]) if len(operands) > 1 else None
    if type_ == "list":
        ok = text.isin([str(x) for x in operands])
    elif type_ == "textLength":
        ok = compare(F.length(text), operator, a, b)
    elif type_ == "whole":
        ok = (num == F.floor(num)) & compare(num, operator, a, b)
    elif type_ in ("decimal", "date", "time"):
        ok = compare(num, operator, a, b)
    else:
        raise AuthoringError(f"rules of type {type_!r} need a formula engine")
    return F.when(blank, F.lit(allow_blank)).otherwise(F.coalesce(ok, F.lit(False)))


def first_rule(cells: DataFrame, rects: DataFrame, broadcast_rects: int = 10_000) -> DataFrame:
    """cells with rule_idx: the first added rule of which a rectangle holds the cell. Few rectangles are broadcast and tried by range; more are cut
    to buckets of rows and joined by key."""
    r = rects.select(F.col("idx").alias("rule_idx"), "top", "left", "bottom", "right")
    inside = F.col("row").between(F.coalesce("top", F.lit(1)), F.coalesce("bottom", F.lit(1048576))) & F.col("col").between(F.coalesce("left", F.lit(1)), F.coalesce("right", F.lit(16384)))
    if r.limit(broadcast_rects + 1).count() <= broadcast_rects:
        j = cells.join(F.broadcast(r), inside)
    else:
        cut = r.withColumn("__b", F.explode(F.sequence(F.floor(F.coalesce("top", F.lit(1)) / 4096), F.floor(F.coalesce("bottom", F.lit(1048576)) / 4096))))
        j = cells.join(cut, (F.floor(F.col("row") / 4096) == F.col("__b")) & inside)
    return j.groupBy(*cells.columns).agg(F.min("rule_idx").alias("rule_idx"))


def top_n(df: DataFrame, column: str, rank: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Adds ``matched``: the value is among the ``rank`` largest (or smallest), or that share of them. The bound is one value, found by an aggregate, so no window over the whole table is needed."""
    x = F.col(column)
    n = df.agg(F.count(x).alias("n")).collect()[0]["n"]
    k = max(1, n * rank // 100) if percent else rank
    bound = df.where(x.isNotNull()).select(column).orderBy(x.asc() if bottom else x.desc()).limit(k).agg((F.max if bottom else F.min)(column).alias("__bound"))
    hit = (x <= F.col("__bound")) if bottom else (x >= F.col("__bound"))
    return df.join(F.broadcast(bound)).withColumn("matched", F.coalesce(hit, F.lit(False))).drop("__bound")  # one row on the right


def above_average(df: DataFrame, column: str, above: bool = True, equal: bool = False, std_dev: int = 0) -> DataFrame:
    x = F.col(column)
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    bound = F.col("__m") + (std_dev if above else -std_dev) * F.col("__s")
    hit = (x > bound if above else x < bound) | (x == bound if equal else F.lit(False))
    return df.join(F.broadcast(stats)).withColumn("matched", F.coalesce(hit, F.lit(False))).drop("__m", "__s")  # one row on the right


def duplicates(df: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """Adds ``matched``: the value occurs more than once (or just once). Values are counted first, then joined back, so a common value is not gathered in one task."""
    key = F.lower(F.col(column).cast("string"))
    counts = df.groupBy(key.alias("__k")).agg(F.count("*").alias("__n")).where(F.col("__k").isNotNull())
    hit = F.col("__n") == 1 if unique else F.col("__n") > 1
    return df.withColumn("__key", key).join(counts, F.col("__key") == F.col("__k"), "left").withColumn("matched", F.coalesce(hit, F.lit(False))).drop("__k", "__n", "__key")


def text_rule(c: Column, type_: str, text: str) -> Column:
    low, t = F.lower(c), text.lower()
    return {"containsText": F.contains(low, F.lit(t)), "notContainsText": ~F.contains(low, F.lit(t)), "beginsWith": low.startswith(t), "endsWith": low.endswith(t)}[type_]


def time_period(t: Column, period: str, as_of: Column) -> Column:
    """Whether a date falls in a named period around ``as_of``. Weeks begin on Sunday; the last seven days include today."""
    day, today = t.cast("date"), as_of.cast("date")
    week = lambda d: F.date_add(F.trunc(F.date_add(d, 1), "week"), -1)
    month = lambda k: F.trunc(day, "month") == F.trunc(F.add_months(today, k), "month")
    periods = {
        "today": day == today, "yesterday": day == F.date_add(today, -1), "tomorrow": day == F.date_add(today, 1), "last7Days": day.between(F.date_add(today, -6), today),
        "thisWeek": week(day) == week(today), "lastWeek": week(day) == F.date_add(week(today), -7), "nextWeek": week(day) == F.date_add(week(today), 7),
        "thisMonth": month(0), "lastMonth": month(-1), "nextMonth": month(1),
    }
    if period not in periods:
        raise AuthoringError(f"unknown period {period!r}")
    return F.coalesce(periods[period], F.lit(False))


def color_scale(df: DataFrame, column: str, points: list[tuple[str, float | None]]) -> DataFrame:
    """Adds ``position``: 0 at the first anchor to len(points) - 1 at the last, linear between. Anchors: min, max, num, percent, percentile."""
    x = F.col(column).cast("double")
    need = [F.min(x).alias("__lo"), F.max(x).alias("__hi")] + [F.percentile(x, F.lit(v / 100)).alias(f"__q{i}") for i, (t, v) in enumerate(points) if t == "percentile"]
    j = df.join(F.broadcast(df.agg(*need)))  # one row on the right
    at = [{"min": F.col("__lo"), "max": F.col("__hi"), "num": F.lit(v), "percent": F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (v or 0) / 100, "percentile": F.col(f"__q{i}") if t == "percentile" else None}[t] for i, (t, v) in enumerate(points)]
    out = F.when(x <= at[0], F.lit(0.0))
    for i in range(len(at) - 1):
        out = out.when(x <= at[i + 1], i + (x - at[i]) / (at[i + 1] - at[i]))
    return j.withColumn("position", F.when(x.isNotNull(), out.otherwise(F.lit(float(len(at) - 1))))).drop("__lo", "__hi", *[f"__q{i}" for i in range(len(points))])


def precedence(matches: DataFrame, cell: list[str]) -> DataFrame:
    """Rules that apply to a cell, by priority, cut after the first that stops."""
    before = W.partitionBy(*cell).orderBy("priority").rowsBetween(W.unboundedPreceding, -1)
    return matches.withColumn("__stop", F.coalesce(F.max(F.col("stop_if_true").cast("int")).over(before), F.lit(0))).where("__stop = 0").drop("__stop")


_TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d+)?)|"((?:[^"]|"")*)"|(\$?[A-Z]{1,3}\$?\d+)(?![A-Za-z0-9(])|([A-Za-z][A-Za-z0-9.]*)|(<=|>=|<>|[-+*/^&=<>(),%]))')
_CALLS = {
    "MOD": lambda a, b: F.when(b < 0, -F.pmod(-a.cast("double"), -b.cast("double"))).otherwise(F.pmod(a.cast("double"), b.cast("double"))), "ABS": F.abs, "LEN": F.length, "UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "INT": F.floor, "ISBLANK": lambda a: a.isNull(), "ISNUMBER": lambda a: a.try_cast("double").isNotNull(),
    "NOT": lambda a: ~a, "AND": lambda *x: reduce(lambda a, b: a & b, x), "OR": lambda *x: reduce(lambda a, b: a | b, x), "IF": lambda c, a, b: F.when(c, a).otherwise(b), "MAX": F.greatest, "MIN": F.least, "SUM": lambda *x: reduce(lambda a, b: a + b, x),
}


def expression(formula: str, top: int, columns: dict[int, Column]) -> Column:
    """Whether an expression rule holds for each row: its references are anchored at the first row of its range and move
    with the row, so references to that row are the row's own columns. References to other rows or pinned rows, and
    functions beyond a small set, are an error: nothing else is evaluated."""
    tokens, at = [], 0
    text = formula.strip().removeprefix("=")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise AuthoringError(f"cannot read {formula!r} from {text[at:]!r} on")
        tokens.append(m)
        at = m.end()
    place = 0

    def op(*known: str) -> str | None:
        nonlocal place
        if place < len(tokens) and tokens[place][5] in known:
            place += 1
            return tokens[place - 1][5]
        return None

    def need(sign: str) -> None:
        if not op(sign):
            raise AuthoringError(f"{sign!r} is missing in {formula!r}")

    def level(signs: dict, below):
        def parse() -> Column:
            out = below()
            while s := op(*signs):
                out = signs[s](out, below())
            return out

        return parse

    def atom() -> Column:
        nonlocal place
        if op("("):
            out = whole()
            need(")")
            return out
        if op("-"):
            return -atom()
        if op("+"):
            return atom()
        if place >= len(tokens):
            raise AuthoringError(f"{formula!r} ends too early")
        m = tokens[place]
        place += 1
        if m[1] is not None:
            out = F.lit(float(m[1]))
        elif m[2] is not None:
            out = F.lit(m[2].replace('""', '"'))
        elif m[3] is not None:
            letters, row = re.match(r"\$?([A-Z]+)(\$?\d+)", m[3]).groups()
            col = reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0)
            if row != str(top) or col not in columns:
                raise AuthoringError(f"{m[3]} lies outside the row")
            out = columns[col]
        elif m[4] is not None and m[4].upper() in ("TRUE", "FALSE"):
            out = F.lit(m[4].upper() == "TRUE")
        elif m[4] is not None and m[4].upper() in _CALLS:
            need("(")
            args = [whole()]
            while op(","):
                args.append(whole())
            need(")")
            out = _CALLS[m[4].upper()](*args)
        else:
            raise AuthoringError(f"{m[0]!r} is not evaluated")
        while op("%"):
            out = out / 100
        return out

    power = level({"^": F.pow}, atom)
    product = level({"*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0))}, power)
    total = level({"+": lambda a, b: a + b, "-": lambda a, b: a - b}, product)
    joined = level({"&": lambda a, b: F.concat(a.cast("string"), b.cast("string"))}, total)
    whole = level({"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}, joined)
    out = whole()
    if place < len(tokens):
        raise AuthoringError(f"cannot read {formula!r} from {tokens[place][0]!r} on")
    return F.coalesce(out, F.lit(False))
