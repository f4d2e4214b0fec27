"""A1 addresses as column expressions, with the grid's limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COL, MAX_ROW = 16384, 1048576


def number_to_column(n: Column) -> Column:
    """1 is A, 702 is ZZ, 703 is AAA; null outside 1..16384."""
    letter = lambda x: F.char(F.lit(65) + x)
    i = (n - 1).cast("int")
    one, two = letter(i % 26), letter(F.floor((i - 26) / 26).cast("int") % 26)
    three = letter(F.floor((i - 702) / 676).cast("int"))
    return F.when((n >= 1) & (n <= 26), one).when((n > 26) & (n <= 702), F.concat(two, one)).when((n > 702) & (n <= MAX_COL), F.concat(three, two, one))


def column_to_number(s: Column) -> Column:
    """Upper-case letters, at most three; null otherwise or beyond the grid."""
    at = lambda k: F.ascii(F.substring(F.lpad(s, 3, "@"), k, 1)) - 64
    n = at(1) * 676 + at(2) * 26 + at(3)
    return F.when(s.rlike(r"^[A-Z]{1,3}\z") & (n <= MAX_COL), n.cast("int"))


def encode_address(row: Column, col: Column) -> Column:
    return F.when(row >= 1, F.concat(number_to_column(col), row.cast("string")))


def decode_address(a: Column) -> Column:
    """Struct row, col of an A1 reference; ``$`` is ignored, an absent axis is null; null if it is none."""
    rx = r"^\$?([A-Z]{0,3})\$?(\d*)\z"
    col, row = F.nullif(F.regexp_extract(a, rx, 1), F.lit("")), F.nullif(F.regexp_extract(a, rx, 2), F.lit(""))
    ok = a.rlike(rx) & (col.isNotNull() | row.isNotNull())
    return F.when(ok, F.struct(row.try_cast("int").alias("row"), column_to_number(col).alias("col")))


def decode_range(a: Column) -> Column:
    """Struct sheet, top, left, bottom, right; corners in either order, an open axis is null."""
    rx = r"^(?:('(?:[^']|'')*'|[^!']*)!)?([^!:]+)(?::([^!:]+))?\z"
    name = F.nullif(F.regexp_extract(a, rx, 1), F.lit(""))
    sheet = F.when(name.startswith("'"), F.replace(F.regexp_replace(name, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(name)
    one, other = decode_address(F.regexp_extract(a, rx, 2)), decode_address(F.coalesce(F.nullif(F.regexp_extract(a, rx, 3), F.lit("")), F.regexp_extract(a, rx, 2)))
    low = lambda f: F.when(one[f].isNotNull() & other[f].isNotNull(), F.least(one[f], other[f]))
    high = lambda f: F.when(one[f].isNotNull() & other[f].isNotNull(), F.greatest(one[f], other[f]))
    return F.when(one.isNotNull() & other.isNotNull(), F.struct(sheet.alias("sheet"), low("row").alias("top"), low("col").alias("left"), high("row").alias("bottom"), high("col").alias("right")))


def sqref_rects(a: Column) -> Column:
    """Array of the rectangles of a space-separated reference."""
    return F.filter(F.transform(F.split(F.trim(a), r"\s+"), decode_range), lambda r: r.isNotNull())


def quote_sheet_name(s: Column) -> Column:
    plain = s.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\z") & ~s.rlike(r"^[A-Za-z]{1,3}\d+\z") & ~s.rlike(r"(?i)^r\d*c\d*\z")
    return F.when(plain, s).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def rects_overlap(a: Column, b: Column) -> Column:
    """Whether two structs top, left, bottom, right meet; an open edge reaches the grid's end."""
    lo, hi = lambda r, f: F.coalesce(r[f], F.lit(1)), lambda r, f, m: F.coalesce(r[f], F.lit(m))
    return (lo(a, "top") <= hi(b, "bottom", MAX_ROW)) & (lo(b, "top") <= hi(a, "bottom", MAX_ROW)) & (lo(a, "left") <= hi(b, "right", MAX_COL)) & (lo(b, "left") <= hi(a, "right", MAX_COL))
