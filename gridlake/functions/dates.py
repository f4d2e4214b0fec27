"""Serial dates, date formats, and the date rules of CSV text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000
#: Built-in number formats by id (fixed values of the file format).
BUILTIN_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
    # dates and times of East Asian locales, which files name by id alone
    27: "[$-404]e/m/d", 28: '[$-404]e"年"m"月"d"日"', 29: '[$-404]e"年"m"月"d"日"', 30: "[$-404]m/d/yy", 31: '[$-404]yyyy"年"m"月"d"日"', 32: '[$-404]h"時"mm"分"', 33: '[$-404]h"時"mm"分"ss"秒"',
    34: '上午/下午h"時"mm"分"', 35: '上午/下午h"時"mm"分"ss"秒"', 36: "[$-404]e/m/d", 50: "[$-404]e/m/d", 51: '[$-404]e"年"m"月"d"日"', 52: '[$-404]yyyy"年"m"月"', 53: '[$-404]m"月"d"日"', 54: '[$-404]e"年"m"月"d"日"',
    55: '上午/下午h"時"mm"分"', 56: '上午/下午h"時"mm"分"ss"秒"', 57: '[$-404]yyyy"年"m"月"', 58: '[$-404]m"月"d"日"',
}


def serial_to_date(s: Column) -> Column:
    """Days since 1899-12-30 with the phantom leap day: serials below 60 are a day later. TIMESTAMP_NTZ, to the millisecond."""
    days = F.when(s < 60, s + 1).otherwise(s) - 25569
    micros = F.round(days * 86_400_000).cast("long") * 1000
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def date_to_serial(t: Column) -> Column:
    days = F.unix_micros(t.cast("timestamp")) / F.lit(float(_DAY)) + 25569
    return F.when(days <= 60, days - 1).otherwise(days)


def is_date_format(code: Column) -> Column:
    """Whether a format code still has one of y m d h s once brackets, quoted text and escapes are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"\[[^\]]*\]", ""), r'"[^"]*"', ""), r"\\.", "")
    return F.coalesce(bare.rlike("(?i)[ymdhs]"), F.lit(False))


CSV_DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?\z"


def csv_date(s: Column) -> Column:
    """The date of a CSV text, null if it is none: days roll over month ends, years 00-99 lie in the 1900s."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(s, CSV_DATE, k), F.lit("")).try_cast("int"), F.lit(0))
    y, m, d, h, mi, sec = (part(k) for k in range(1, 7))
    ok = s.rlike(CSV_DATE) & m.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (sec <= 59)
    year = F.when(y < 100, y + 1900).otherwise(y)
    day = F.date_add(F.try_make_date(year, m, F.lit(1)) if hasattr(F, "try_make_date") else F.make_date(F.when(ok, year), F.when(ok, m), F.when(ok, F.lit(1))), d - 1)
    return F.when(ok, (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, mi, sec.cast("decimal(18,6)"))))


def format_csv_date(t: Column, fmt: str) -> Column:
    """Tokens YYYY YY MM M DD D HH H mm m ss s; anything else is literal."""
    import re

    java = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "HH": "HH", "H": "H", "mm": "mm", "m": "m", "ss": "ss", "s": "s"}
    pieces = []
    for tok, lit in re.findall(r"(YYYY|YY|MM|M|DD|D|HH|H|mm|m|ss|s)|([^YMDHms]+|.)", fmt):
        pieces.append(F.date_format(t, java[tok]) if tok else F.lit(lit))
    return F.concat(*pieces)


def builtin_format(fmt_id: Column) -> Column:
    """Code of a built-in number format, null for ids without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in sorted(BUILTIN_FORMATS.items()) for x in (k, v)]), fmt_id.cast("int"))
