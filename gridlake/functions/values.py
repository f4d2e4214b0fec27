"""Cell values: kinds, text, wrapped lines."""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error literals (fixed values of the file format).
ERRORS = ["#N/A", "#REF!", "#NAME?", "#DIV/0!", "#NULL!", "#VALUE!", "#NUM!", "#SPILL!", "#CALC!", "#GETTING_DATA"]
KINDS = ["null", "number", "string", "boolean", "date", "error", "formula", "richText", "hyperlink"]
SAFE = float(2**53 - 1)
CSV_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\z"


def number_text(x: float | None) -> str | None:
    """A double as ECMAScript prints it: shortest digits, exponents from 1e21 and below 1e-6."""
    if x is None or x != x:
        return None if x is None else "NaN"
    if not isfinite(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, (mantissa, _, exponent) = ("-" if x < 0 else ""), repr(abs(x)).partition("e")
    whole, _, frac = mantissa.partition(".")
    digits = (whole + frac).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + frac) - len(digits))
    digits = digits.rstrip("0") or "0"
    if 0 < point <= 21:
        body = digits + "0" * (point - len(digits)) if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"
    return sign + body


def js_number(c: Column) -> Column:
    """Whole numbers below 2^53 stay in the JVM; other doubles need shortest digits, which Java 17 does not always print."""

    @F.pandas_udf("string")
    def digits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if pd.isna(x) else number_text(float(x)))

    whole = (c == F.floor(c)) & (F.abs(c) <= SAFE)
    return F.when(c.isNull(), None).when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(digits(F.when(~whole, c)))


def iso_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def value_text(kind: Column, num: Column, string: Column, boolean: Column, ts: Column, err: Column) -> Column:
    """Text of a cell: empty for null and an invalid date; formulas pass their result's kind."""
    return F.coalesce(
        F.when(kind == "number", js_number(num)).when(kind.isin("string", "richText", "hyperlink"), string).when(kind == "boolean", F.when(boolean, "TRUE").otherwise("FALSE")).when(kind == "date", iso_text(ts)).when(kind == "error", err),
        F.lit(""),
    )


def rich_to_plain(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def strip_equals(formula: Column) -> Column:
    return F.regexp_replace(formula, "^=", "")


def wrapped_lines(text: Column, width: int) -> Column:
    """Lines a text takes at a width: each paragraph at least one."""
    per = F.transform(F.split(text, r"\r\n?|\n", -1), lambda s: F.greatest(F.lit(1), F.ceil(F.length(s) / width)).cast("long"))
    return F.aggregate(per, F.lit(0).cast("long"), lambda a, x: a + x)


def csv_value(field: Column) -> Column:
    """Struct kind, num, str, ts of a CSV field: empty is null; numbers up to 2^53 - 1; dates; else text."""
    from . import dates

    num = F.when(field.rlike(CSV_NUMBER), field.try_cast("double"))
    num = F.when(F.abs(num) <= SAFE, num)
    ts = dates.csv_date(field)
    kind = F.when(field.isNull() | (field == ""), "null").when(num.isNotNull(), "number").when(ts.isNotNull(), "date").otherwise("string")
    return F.struct(kind.alias("kind"), num.alias("num"), F.when(kind == "string", field).alias("str"), F.when(kind == "date", ts).alias("ts"))


def literal_number(text: Column) -> Column:
    """Struct num, str of an operand's text: a plain decimal literal is a number, all else stays as it is."""
    num = F.when(F.trim(text).rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), F.trim(text).try_cast("double"))
    return F.struct(num.alias("num"), F.when(num.isNull(), text).alias("str"))


def operand(type_: Column, text: Column) -> Column:
    """A validation operand as stored: without a leading ``=``, a number only if it is a literal and the rule is no list and no formula."""
    bare = F.regexp_replace(text, "^=", "")
    as_text = F.struct(F.lit(None).cast("double").alias("num"), bare.alias("str"))
    return F.when(type_.isin("list", "custom"), as_text).otherwise(literal_number(bare))


def flag(text: Column, mode: str = "strict") -> Column:
    """A stored boolean. present: on unless it says no; strict: on only if it says yes; tristate: null where it says neither."""
    yes, no = text.isin("1", "true"), text.isin("0", "false")
    if mode == "present":
        return ~F.coalesce(no, F.lit(False))
    if mode == "strict":
        return F.coalesce(yes, F.lit(False))
    return F.when(yes, True).when(no, False)


def guid(text: Column) -> Column:
    """{XXXXXXXX-XXXX-XXXX-XXXX-XXXXXXXXXXXX} of any spelling, null for what is none."""
    bare = F.regexp_replace(F.trim(text), "^\\{?([0-9A-Fa-f]{8})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{4})-?([0-9A-Fa-f]{12})\\}?$", "{$1-$2-$3-$4-$5}")
    return F.when(bare.rlike("^\\{[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\\}$"), F.upper(bare))


def pivot_scalar(kind: Column, num: Column, string: Column, boolean: Column, ts: Column, err: Column) -> Column:
    """Struct num, str of what a pivot takes from a cell: a finite number, a text (booleans, dates and errors as text), or
    a blank (both null). The kind of a formula is its result's."""
    finite = ~F.isnan(num) & (F.abs(num) != float("inf"))
    text = F.when(kind.isin("string", "richText", "hyperlink"), string).when(kind == "boolean", F.when(boolean, "TRUE").otherwise("FALSE")).when(kind == "date", iso_text(ts)).when(kind == "error", err)
    return F.struct(F.when((kind == "number") & finite, num).alias("num"), text.alias("str"))


#: What the guards ask of a cell's kind.
GUARDS = {"isErrorValue": ("error",), "isFormulaValue": ("formula", "sharedFormula"), "isSharedFormulaValue": ("sharedFormula",), "isDataTableFormulaValue": ("dataTable",), "isRichTextValue": ("richText",), "isHyperlinkValue": ("hyperlink",)}


def is_kind(guard: str, kind: Column) -> Column:
    return F.coalesce(kind.isin(*GUARDS[guard]), F.lit(False))


def is_error_code(text: Column) -> Column:
    return F.coalesce(text.isin(*sorted(ERRORS)), F.lit(False))
