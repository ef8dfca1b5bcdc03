"""String helpers expressed with built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetlens.model import UNICODE_WS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Trim every Unicode White_Space character from both ends.

    Spark's one-argument ``trim`` strips only U+0020.
    """
    return F.trim(_col(c), F.lit(UNICODE_WS))


def argb_to_rgb(c: Column | str) -> Column:
    """ARGB text -> upper-case ``RRGGBB``; alpha ignored.

    Needs at least 8 characters and six hex digits at positions 3-8, otherwise
    NULL (no colour).
    """
    s = _col(c)
    rgb = F.substring(s, 3, 6)
    return F.when((F.length(s) >= 8) & rgb.rlike("^[0-9A-Fa-f]{6}$"), F.upper(rgb))


def display_hex(c: Column | str) -> Column:
    """ARGB -> display hex: strip leading '#', drop alpha of an 8-char value, upper-case."""
    s = F.regexp_replace(_col(c), "^#+", "")
    return F.upper(F.when(F.length(s) == 8, F.substring(s, 3, 6)).otherwise(s))


def extension(path: Column | str) -> Column:
    """File extension after the last dot of the last path segment ('' when none)."""
    return F.regexp_extract(_col(path), r"\.([^./]+)$", 1)


def rgb_components(hex_rgb: Column | str) -> Column:
    """``RRGGBB`` -> struct<r, g, b> of 0..255 integers (NULL in, NULL out)."""
    h = _col(hex_rgb)
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def tinted(argb: Column | str, tint: Column | str) -> Column:
    """ARGB -> ``FFRRGGBB`` with the tint of a theme colour: a negative one darkens the lightness L to L * (1 + tint),
    a positive one lightens it to L * (1 - tint) + tint; hue and saturation stay.  No tint (NULL or 0), or no ARGB
    colour: the text as it is.

    At constant hue and saturation a channel's distance from the lightness is in proportion to min(L, 1 - L), so
    the colour needs no conversion to HSL and back."""
    a, t = _col(argb), _col(tint)
    let = lambda value, fn: F.get(F.transform(F.array(value), fn), 0)  # noqa: E731 - evaluates ``value`` once
    channel = lambda v, i: F.conv(F.substring(v["a"], i, 2), 16, 10).cast("double") / 255
    edge = lambda x: F.least(x, 1 - x)

    def shifted(v: Column) -> Column:
        light = (F.greatest(v["r"], v["g"], v["b"]) + F.least(v["r"], v["g"], v["b"])) / 2
        new = F.when(v["t"] < 0, light * (1 + v["t"])).otherwise(light * (1 - v["t"]) + v["t"])
        return let(F.struct(light.alias("l"), new.alias("n"), *[v[c].alias(c) for c in "rgb"]), scaled)

    def scaled(w: Column) -> Column:
        k = F.when(edge(w["l"]) > 0, edge(w["n"]) / edge(w["l"])).otherwise(0.0)
        byte = lambda c: F.lpad(F.hex(F.floor(255 * (w["n"] + (w[c] - w["l"]) * k) + 0.5 + 1e-9)), 2, "0")
        return F.concat(F.lit("FF"), *[byte(c) for c in "rgb"])

    parts = lambda v: let(F.struct(channel(v, 3).alias("r"), channel(v, 5).alias("g"), channel(v, 7).alias("b"),
                                   F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["t"])).alias("t")), shifted)
    return let(F.struct(a.alias("a"), t.alias("t")), lambda v: F.when(
        (v["t"] != 0) & v["a"].rlike("^[0-9A-Fa-f]{8}$"), parts(v)).otherwise(v["a"]))
