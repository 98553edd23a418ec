"""Coordinate reference systems: EPSG codes in text, descriptors, and guesses from a file's first point."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .projection import web_mercator_to_lnglat

#: The UTM families; the codes told from coordinates; half the side of the Mercator map; the box that stands for the
#: Canary Islands (west, east, south, north); the eastings and northings of their zone; what is assumed of all others.
UTM_CODES = ((32601, 32660), (32701, 32760), (25801, 25860))
SOUTHERN = 32700
GEOGRAPHIC, MERCATOR = 4326, 3857
MERCATOR_LIMIT = 20037508.342789244
CANARIES = (-18, -13, 26, 30)
CANARY_EASTINGS, CANARY_NORTHINGS = (100_000, 900_000), (2_500_000, 4_000_000)
CANARY_ZONE, ELSEWHERE = 32628, 25830


def is_utm(code):
    """Of a column, or of a plain number."""
    inside = [(code >= low) & (code <= high) for low, high in UTM_CODES]
    return inside[0] | inside[1] | inside[2]


def guess(x, y, lng, lat, choose):
    """A code for files that name none, from a point's coordinates and from what they would be on the Mercator map.

    choose(condition, then, otherwise) tells columns from plain numbers.
    """
    west, east, south, north = CANARIES
    degrees = (abs_(x) <= 180) & (abs_(y) <= 90)
    on_map = (abs_(x) <= MERCATOR_LIMIT) & (abs_(y) <= MERCATOR_LIMIT) & (lng > west) & (lng < east) & (lat > south) & (lat < north)
    zone = (x >= CANARY_EASTINGS[0]) & (x <= CANARY_EASTINGS[1]) & (y >= CANARY_NORTHINGS[0]) & (y <= CANARY_NORTHINGS[1])
    return choose(degrees, GEOGRAPHIC, choose(on_map, MERCATOR, choose(zone, CANARY_ZONE, ELSEWHERE)))


def abs_(x):
    return F.abs(x) if isinstance(x, Column) else abs(x)


def epsg_in(text: Column) -> Column:
    """The first UTM code among a text's runs of digits, else the first of 4326 and 3857, else the first run."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4,5})"), 1), lambda x: x.cast("int"))
    first = lambda kept: F.try_element_at(kept, F.lit(1))
    return F.coalesce(first(F.filter(codes, is_utm)), first(F.filter(codes, lambda c: c.isin(GEOGRAPHIC, MERCATOR))), first(codes))


def crs_of(code: Column, source: Column | str) -> Column:
    """struct<kind, code, zone, northern, label>; null for codes that cannot be projected."""
    source = source if isinstance(source, Column) else F.lit(source)
    code = code.cast("int")
    zone, northern = (code % 100).cast("int"), code < SOUTHERN
    plain = F.concat(F.lit("EPSG:"), code.cast("string"))
    tail = F.concat(F.lit(" ("), source, F.lit(")"))

    def crs(kind: str, zone: Column, northern: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), code.alias("code"), zone.cast("int").alias("zone"), northern.cast("boolean").alias("northern"), label.alias("label"))

    utm_label = F.concat(plain, F.lit(" UTM zona "), zone.cast("string"), F.when(northern, "N").otherwise("S"), tail)
    return (
        F.when(code == GEOGRAPHIC, crs("geographic", F.lit(None), F.lit(None), F.concat(plain, tail)))
        .when(code == MERCATOR, crs("web-mercator", F.lit(None), F.lit(None), F.concat(plain, tail)))
        .when(is_utm(code), crs("utm", zone, northern, utm_label))
    )


def inferred_epsg(x: Column, y: Column) -> Column:
    """A code for files that name none: degrees, Mercator over the Canary Islands, their UTM zone, or the Iberian default."""
    at = web_mercator_to_lnglat(x, y)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return guess(x, y, at["lng"], at["lat"], lambda c, a, b: F.when(c, lit(a)).otherwise(lit(b)))
