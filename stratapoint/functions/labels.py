"""Texts and colours for tiles, distances, counts and durations. Decimals come from integers, so that no engine's rounding shows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def _finite(x: Column) -> Column:
    return x.isNotNull() & (x < INFINITY) & (x > -INFINITY)


def rounded(x: Column) -> Column:
    """To the nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def decimals(x: Column, digits: int) -> Column:
    """A number of zero or more with a fixed number of decimals."""
    if not digits:
        return rounded(x).cast("string")
    scaled = F.floor(x * 10**digits + 0.5).cast("long")
    return F.concat(F.floor(scaled / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0"))


def grouped(digits: Column) -> Column:
    """A string of digits with a comma before every three from the right."""
    return F.regexp_replace(digits, r"(\d)(?=(\d{3})+$)", "$1,")


def integer(x: Column) -> Column:
    return F.when(_finite(x), grouped(rounded(x).cast("string"))).otherwise("-")


def number(x: Column, digits: int = 0) -> Column:
    if not digits:
        return integer(x)
    text = decimals(x, digits)
    return F.when(_finite(x), F.concat(grouped(F.substring_index(text, ".", 1)), F.lit("."), F.substring_index(text, ".", -1))).otherwise("-")


def duration(ms: Column) -> Column:
    seconds = F.when(ms < 10_000, decimals(ms / 1000, 2)).otherwise(decimals(ms / 1000, 1))
    return F.when(~_finite(ms), "-").when(ms < 1000, F.concat(rounded(ms).cast("string"), F.lit(" ms"))).otherwise(F.concat(seconds, F.lit(" s")))


def distance(m: Column) -> Column:
    km = F.when(m < 10_000, decimals(m / 1000, 1)).otherwise(decimals(m / 1000, 0))
    return F.when(~_finite(m), "").when(m < 1000, F.concat(rounded(m).cast("string"), F.lit(" m"))).otherwise(F.concat(km, F.lit(" km")))


def ratio(r: Column) -> Column:
    text = F.when(r < 10, decimals(r, 2)).otherwise(decimals(r, 1))
    return F.when(r == INFINITY, "inf").when(~_finite(r), "").otherwise(F.concat(text, F.lit("x")))


def fixed(x: Column, digits: int) -> Column:
    """A number of any sign with a fixed number of decimals."""
    return F.concat(F.when(x < 0, "-").otherwise(""), decimals(F.abs(x), digits))


def lnglat_bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    """West, south / east, north; a dash without bounds."""
    a, b, c, d = (fixed(x, 5) for x in (west, south, east, north))
    return F.coalesce(F.concat(a, F.lit(", "), b, F.lit(" / "), c, F.lit(", "), d), F.lit("-"))


def indexing_mode(mode: Column) -> Column:
    return F.when(mode == "m3no", "M3NO").otherwise("QuadTree")


def tile_type(parent_id: Column, child_count: Column) -> Column:
    return F.when(parent_id.isNull(), "root").when(child_count > 0, "intermediate").otherwise("leaf")


def detail(parent_id: Column, child_count: Column, depth: Column, metres: Column, diagonal: Column) -> Column:
    share = F.when((metres > 0) & (metres < INFINITY), diagonal / F.when(metres > 0, metres)).otherwise(INFINITY)
    return F.concat(tile_type(parent_id, child_count), F.lit(" LOD "), depth.cast("string"), F.lit(" - "), distance(metres), F.lit(" - diag/dist "), ratio(share))


#: LAS classes with their names and colours, and the colour of all others.
CLASSES = [
    (0, "Created, never classified", (0.9, 0.04, 0.12, 0.86)),
    (1, "Unclassified", (0.86, 0.08, 0.14, 0.86)),
    (2, "Ground", (0.58, 0.35, 0.18, 0.9)),
    (3, "Low vegetation", (0.55, 0.78, 0.28, 0.88)),
    (4, "Medium vegetation", (0.28, 0.66, 0.22, 0.88)),
    (5, "High vegetation", (0.1, 0.48, 0.16, 0.88)),
    (6, "Building", (0.95, 0.48, 0.12, 0.9)),
    (7, "Low point / noise", (0.42, 0.45, 0.5, 0.72)),
    (8, "Model key point", (1.0, 0.95, 0.28, 0.92)),
    (9, "Water", (0.1, 0.42, 0.92, 0.9)),
    (10, "Rail", (0.5, 0.32, 0.9, 0.9)),
    (11, "Road surface", (0.95, 0.78, 0.12, 0.9)),
    (17, "Bridge deck", (0.7, 0.28, 0.96, 0.9)),
    (18, "High noise", (0.98, 0.18, 0.7, 0.9)),
]
OTHER_CLASS = ("Other", (0.94, 0.05, 0.14, 0.86))


def hsl_to_rgb(hue: Column, saturation: Column, lightness: Column) -> Column:
    """struct<red, green, blue>, each between 0 and 1."""
    span = (F.lit(1.0) - F.abs(lightness * 2 - 1)) * saturation

    def channel(offset: int) -> Column:
        # How far the hue is from this channel's own, in sixths of the circle, tells how much of the span it gets.
        away = F.abs(F.pmod(hue * 6 + offset, F.lit(6.0)) - 3.0) - 1.0
        return lightness + span * (F.least(F.greatest(away, F.lit(0.0)), F.lit(1.0)) - 0.5)

    return F.struct(channel(0).alias("red"), channel(4).alias("green"), channel(2).alias("blue"))


def clamped_value(given: Column, fallback: float, low: float | None = None, high: float | None = None) -> Column:
    """config.clamped of a column: a number given as text or number, between the limits; the fallback for what is no finite number."""
    number = given.try_cast("double")
    held = number if low is None else F.greatest(number, F.lit(float(low)))
    held = held if high is None else F.least(held, F.lit(float(high)))
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(float(fallback))).otherwise(held)
