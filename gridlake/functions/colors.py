"""Colour references resolved to ARGB text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The theme slots by number with the usual office scheme, and the built-in palette.
THEME = {
    "lt1": "FFFFFF", "dk1": "000000", "lt2": "E7E6E6", "dk2": "44546A", "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000", "accent5": "5B9BD5",
    "accent6": "70AD47", "hlink": "0563C1", "folHlink": "954F72",
}
_FIRST = "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF"
PALETTE = f"""
{_FIRST} {_FIRST}
800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF
000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99
3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333
""".split()


def normal_argb(c: Column) -> Column:
    """Six or eight hex digits, with or without ``#``, as eight upper-case ones; null otherwise."""
    h = F.upper(F.regexp_replace(c, "^#", ""))
    return F.when(h.rlike(r"^[0-9A-F]{8}\z"), h).when(h.rlike(r"^[0-9A-F]{6}\z"), F.concat(F.lit("FF"), h))


def tinted(argb: Column, tint: Column) -> Column:
    """Lightness moved towards black (tint below 0) or white, hue and saturation kept. With both kept, a channel's
    distance from the lightness scales as the chroma that the lightness leaves room for."""
    rgb = [F.conv(F.substring(argb, at, 2), 16, 10).cast("double") / 255 for at in (3, 5, 7)]
    light = (F.greatest(*rgb) + F.least(*rgb)) / 2
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint)))
    room = 1 - F.abs(2 * light - 1)
    scale = F.when(room > 0, (1 - F.abs(2 * moved - 1)) / F.nullif(room, F.lit(0.0))).otherwise(F.lit(0.0))
    channel = lambda x: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved + (x - light) * scale)) * 255 + 0.5).cast("long")), 2, "0")
    return F.concat(F.substring(argb, 1, 2), *[channel(x) for x in rgb])


def resolved(argb: Column, theme: Column, indexed: Column, tint: Column, scheme: dict[str, str] | None = None, palette: list[str] | None = None) -> Column:
    """An explicit colour, else the theme's slot, else the palette's entry, then the tint; null for system colours and unknown numbers."""
    slots = scheme or THEME
    themes = F.array(*[F.lit(slots[k].upper() if k in slots else None).cast("string") for k in THEME])
    entries = F.array(*[F.lit(p).cast("string") for p in (palette or PALETTE)])
    at = lambda a, i: F.when(i >= 0, F.get(a, i))
    slot = F.concat(F.lit("FF"), at(themes, theme))
    entry = F.concat(F.lit("FF"), F.right(normal_argb(F.when(~indexed.isin(64, 65), at(entries, indexed))), F.lit(6)))
    base = F.when(argb.isNotNull(), normal_argb(argb)).when(theme.isNotNull(), slot).otherwise(entry)
    plain = tint.isNull() | F.isnan(tint) | (F.abs(tint) == float("inf")) | (tint == 0)
    return F.when(plain, base).otherwise(tinted(base, tint))
