"""Map projections as column expressions: transverse Mercator by Snyder's series, spherical Mercator, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
MEAN_RADIUS = 6371008.8
MAX_MERCATOR_LAT = 85.05112878

#: Coefficients of the meridian arc: of the latitude, and of the sines of its even multiples.
ARC = (
    1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
    -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024),
    15 * E2**2 / 256 + 45 * E2**3 / 1024,
    -35 * E2**3 / 3072,
)
_N = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
#: Coefficients of the footpoint latitude's sines.
FOOT = (3 * _N / 2 - 27 * _N**3 / 32, 21 * _N**2 / 16 - 55 * _N**4 / 32, 151 * _N**3 / 96, 1097 * _N**4 / 512)


def _series(angle: Column, factors) -> Column:
    total = F.lit(0.0)
    for k, factor in enumerate(factors, 1):
        total = total + F.sin(angle * (2 * k)) * factor
    return total


def central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6 - 183.0)


#: The projections in steps, each a few named values over those before it, so that no subexpression is written twice.
TO_LNGLAT = [
    {"mu": lambda v: (v["north"] - F.when(v["northern"], 0.0).otherwise(10_000_000.0)) / (SCALE * SEMI_MAJOR * ARC[0])},
    {"foot": lambda v: v["mu"] + _series(v["mu"], FOOT)},
    {"sin": lambda v: F.sin(v["foot"]), "cos": lambda v: F.cos(v["foot"]), "tan": lambda v: F.tan(v["foot"])},
    {"c": lambda v: v["cos"] * v["cos"] * EP2, "t": lambda v: v["tan"] * v["tan"], "w": lambda v: F.lit(1.0) - v["sin"] * v["sin"] * E2},
    {"d": lambda v: (v["east"] - 500_000.0) * F.sqrt(v["w"]) / (SEMI_MAJOR * SCALE)},
    {"dd": lambda v: v["d"] * v["d"]},
    {
        # The normal radius over the meridional one is w / (1 - E2).
        "lat": lambda v: F.degrees(
            v["foot"]
            - v["tan"] * v["w"] / (1 - E2) * v["dd"]
            * (0.5 - v["dd"] * ((v["t"] * 3 + v["c"] * 10 - v["c"] * v["c"] * 4 + (5 - 9 * EP2)) / 24
                                - v["dd"] * (v["t"] * 90 + v["c"] * 298 + v["t"] * v["t"] * 45 - v["c"] * v["c"] * 3 + (61 - 252 * EP2)) / 720))
        ),
        "lng": lambda v: F.degrees(
            central_meridian(v["zone"])
            + v["d"] / v["cos"]
            * (F.lit(1.0) - v["dd"] * ((v["t"] * 2 + v["c"] + 1) / 6
                                       - v["dd"] * (v["t"] * 28 - v["c"] * 2 - v["c"] * v["c"] * 3 + v["t"] * v["t"] * 24 + (5 + 8 * EP2)) / 120))
        ),
    },
]
TO_UTM = [
    {"phi": lambda v: F.radians(v["lat"])},
    {"sin": lambda v: F.sin(v["phi"]), "cos": lambda v: F.cos(v["phi"]), "tan": lambda v: F.tan(v["phi"])},
    {
        "n": lambda v: F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - v["sin"] * v["sin"] * E2),
        "t": lambda v: v["tan"] * v["tan"],
        "c": lambda v: v["cos"] * v["cos"] * EP2,
        "a": lambda v: (F.radians(v["lng"]) - central_meridian(v["zone"])) * v["cos"],
        "arc": lambda v: (v["phi"] * ARC[0] + _series(v["phi"], ARC[1:])) * SEMI_MAJOR,
    },
    {"aa": lambda v: v["a"] * v["a"]},
    {
        "x": lambda v: 500_000.0 + v["n"] * SCALE * v["a"]
        * (F.lit(1.0) + v["aa"] * ((v["c"] - v["t"] + 1) / 6 + v["aa"] * (v["t"] * v["t"] - v["t"] * 18 + v["c"] * 72 + (5 - 58 * EP2)) / 120)),
        "y": lambda v: F.when(v["northern"], 0.0).otherwise(10_000_000.0)
        + (v["arc"] + v["n"] * v["tan"] * v["aa"]
           * (0.5 + v["aa"] * ((v["c"] * 9 - v["t"] + v["c"] * v["c"] * 4 + 5) / 24 + v["aa"] * (v["t"] * v["t"] - v["t"] * 58 + v["c"] * 600 + (61 - 330 * EP2)) / 720))) * SCALE,
    },
]


def _extended(names: tuple[str, ...], step: dict):
    return lambda v: F.struct(*(v[n].alias(n) for n in names), *(f(v).alias(k) for k, f in step.items()))


def _bound(inputs: dict[str, Column], steps: list[dict], outputs: tuple[str, ...]) -> Column:
    """The steps as one expression: each is a function applied to the struct of the values so far."""
    at, names = F.array(F.struct(*(c.alias(n) for n, c in inputs.items()))), tuple(inputs)
    for step in steps:
        at = F.transform(at, _extended(names, step))
        names += tuple(step)
    return F.transform(at, lambda v: F.struct(*(v[n].alias(n) for n in outputs)))[0]


def _staged(df: DataFrame, inputs: dict[str, Column], steps: list[dict], outputs: tuple[str, ...]) -> DataFrame:
    """The steps as projections one after another, which Spark compiles; for tables of points."""
    df = df.withColumns({f"_p_{n}": c for n, c in inputs.items()})
    names = list(inputs)
    for step in steps:
        values = {n: F.col(f"_p_{n}") for n in names}
        df = df.withColumns({f"_p_{k}": f(values) for k, f in step.items()})
        names += step
    return df.withColumns({n: F.col(f"_p_{n}") for n in outputs}).drop(*(f"_p_{n}" for n in names))


def _given(zone: Column | int, northern: Column | bool) -> dict[str, Column]:
    zone, northern = (x if isinstance(x, Column) else F.lit(x) for x in (zone, northern))
    return {"zone": zone, "northern": F.coalesce(northern, F.lit(True))}


def utm_to_lnglat(easting: Column, northing: Column, zone: Column | int, northern: Column | bool = True) -> Column:
    """struct<lng, lat> in degrees of a UTM position."""
    return _bound({"east": easting, "north": northing, **_given(zone, northern)}, TO_LNGLAT, ("lng", "lat"))


def with_lnglat(df: DataFrame, easting: Column, northing: Column, zone: Column | int, northern: Column | bool = True) -> DataFrame:
    """df with lng and lat of a UTM position."""
    return _staged(df, {"east": easting, "north": northing, **_given(zone, northern)}, TO_LNGLAT, ("lng", "lat"))


def lnglat_to_utm(lng: Column, lat: Column, zone: Column | int, northern: Column | bool = True) -> Column:
    """struct<x, y> in metres of a position in degrees."""
    return _bound({"lng": lng, "lat": lat, **_given(zone, northern)}, TO_UTM, ("x", "y"))


def web_mercator(lng: Column, lat: Column) -> Column:
    """struct<x, y> in spherical Mercator metres; latitudes beyond the square map are clamped."""
    lat = F.least(F.greatest(lat, F.lit(-MAX_MERCATOR_LAT)), F.lit(MAX_MERCATOR_LAT))
    return F.struct((F.radians(lng) * SEMI_MAJOR).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SEMI_MAJOR).alias("y"))


def web_mercator_to_lnglat(x: Column, y: Column) -> Column:
    return F.struct(F.degrees(x / SEMI_MAJOR).alias("lng"), F.degrees(F.atan(F.exp(y / SEMI_MAJOR)) * 2 - math.pi / 2).alias("lat"))


def to_lnglat(x: Column, y: Column, kind: Column, zone: Column, northern: Column) -> Column:
    """struct<lng, lat> for coordinates of a file whose CRS is of this kind; null for kinds unknown."""
    return (
        F.when(kind == "geographic", F.struct(x.alias("lng"), y.alias("lat")))
        .when(kind == "web-mercator", web_mercator_to_lnglat(x, y))
        .when(kind == "utm", utm_to_lnglat(x, y, zone, northern))
    )


def to_metric(lng: Column, lat: Column, kind: Column, zone: Column, northern: Column) -> Column:
    """struct<x, y> in the plane in which a file's tiles lie."""
    return F.when((kind == "utm") & zone.isNotNull(), lnglat_to_utm(lng, lat, zone, F.coalesce(northern, F.lit(True)))).otherwise(web_mercator(lng, lat))


def metric_of_file(x: Column, y: Column, kind: Column) -> Column:
    """struct<x, y>: a file's own coordinates, or Mercator metres where they are degrees."""
    return F.when(kind == "geographic", web_mercator(x, y)).otherwise(F.struct(x.alias("x"), y.alias("y")))


def valid_lnglat(lng: Column, lat: Column) -> Column:
    # NaN sorts above every number in Spark, so it fails both comparisons, as infinities do.
    return (F.abs(lng) <= 180) & (F.abs(lat) <= 90)


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere of the earth's mean radius."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h)) * (2 * MEAN_RADIUS)
