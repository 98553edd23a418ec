"""Payloads of tiles: their points side by side in arrays, as a store keeps them, and back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .sampling import places

#: The fields of a payload: x, y and height of each point in turn, and the points' classes.
FIELDS = ("point_count", "coordinates", "classifications")


#: Points of a part of a payload; and numbers of a bucket in which places are counted.
PART_POINTS, WIDTH = 65_536, 1_000_000


def parted(points: DataFrame, by: list[str], order: str, size: int = PART_POINTS) -> DataFrame:
    """points with `part`, by their place in the order of a tile: a tile of any size is parts of at most `size` points."""
    rows = places(points, by, order, WIDTH, "_place").withColumn("part", F.floor(F.col("_place") / size).cast("int"))
    return rows.drop("_place", "group_size")


def packed(points: DataFrame, by: list[str], order: str, axes: tuple[str, str, str] = ("mx", "my", "z"), size: int = PART_POINTS) -> DataFrame:
    """A row for each part of a tile with `payload`. points: `by`, order, a whole number unique in a tile, axes, classification."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order), *(F.col(a).alias(f"c{i}") for i, a in enumerate(axes)), F.col("classification").alias("k"))))
    rows = parted(points, by, order, size).groupBy(*by, "part").agg(own.alias("_p"))  # PART_POINTS at most
    flat = F.flatten(F.transform("_p", lambda p: F.array(p["c0"], p["c1"], p["c2"])))
    return rows.select(*by, "part", payload(F.size("_p").cast("long"), flat, F.transform("_p", lambda p: p["k"])).alias("payload"))


def payload(count: Column, coordinates: Column, classifications: Column) -> Column:
    """What is stored: nothing for a tile without points."""
    return F.when(count > 0, F.struct(*(c.alias(n) for c, n in zip((count, coordinates, classifications), FIELDS))))


def point_count(points: Column, kind: T.DataType) -> Column:
    """The number of points of a payload, of an array of points, or of a single point; none for null."""
    if isinstance(kind, T.ArrayType):
        return F.when(points.isNull(), 0).otherwise(F.size(points)).cast("long")
    if isinstance(kind, T.StructType) and set(FIELDS) <= set(kind.names):
        return F.coalesce(points["point_count"], F.lit(0)).cast("long")
    return F.when(points.isNull(), 0).otherwise(1).cast("long")


def unpacked(tiles: DataFrame, by: list[str], axes: tuple[str, str, str] = ("mx", "my", "z"), size: int = PART_POINTS) -> DataFrame:
    """A row for each point of each part of a payload, with its place in the tile; tiles without a payload give none."""
    rows = tiles.where("payload IS NOT NULL").select(*by, "part", F.col("payload.coordinates").alias("_c"), F.posexplode("payload.classifications").alias("_at", "classification"))
    place = F.col("part").cast("long") * size + F.col("_at")
    return rows.select(*by, place.alias("place"), *(F.element_at("_c", F.col("_at") * 3 + i + 1).alias(a) for i, a in enumerate(axes)), "classification")
