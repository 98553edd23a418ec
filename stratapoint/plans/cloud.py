"""A point cloud and cameras made from the star-schema tables: two files of points in UTM 28N, cameras from events.

Integers up to scale and offset, so that any engine gets the same bits. point_index is unique within the cloud and
needs no order over the whole table: it numbers the lines of each order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratapoint.config import Bounds, IndexConfig, LodConfig
from stratapoint.sources.scratch import stored

FLAT = Bounds(456000.0, 3110000.0, 460000.0, 3114000.0)
SOLID = Bounds(456000.0, 3110000.0, 460000.0, 3114000.0, 0.0, 300.0)
CONFIG = IndexConfig()
LOD = LodConfig()
DEPTH = CONFIG.depth_for(FLAT.diagonal)
LABEL = "EPSG:32628 UTM zona 28N (WKT)"
CRS = ("utm", 32628, 28, True, LABEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnumbered_points(lines: DataFrame, *more) -> DataFrame:
    """file_index and raw coordinates of a point for each row of lineitem."""
    return lines.select(
        F.expr("cast(l_suppkey % 2 as int)").alias("file_index"),
        *more,
        F.expr("cast((l_partkey * 7919L + l_orderkey * 104729L) % 400000 as int)").alias("raw_x"),
        F.expr("cast((l_suppkey * 6151L + l_orderkey * 15485863L) % 400000 as int)").alias("raw_y"),
        F.expr("cast((cast(l_quantity as bigint) * 977 + l_linenumber * 131) % 30000 as int)").alias("raw_z"),
        F.expr("cast(if(l_partkey % 97 = 0, 64, l_linenumber + 1) as int)").alias("classification"),
    )


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return unnumbered_points(table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") * 1000 + F.row_number().over(own) - 1).alias("point_index"))


def decoded(points: DataFrame) -> DataFrame:
    """Scale and offset, as a reader of point records applies them."""
    return points.withColumns({
        "x": F.col("raw_x") * F.lit(0.01) + F.lit(456000.0), "y": F.col("raw_y") * F.lit(0.01) + F.lit(3110000.0), "z": F.col("raw_z") * F.lit(0.01),
    })


_RAW: dict[tuple[str, str], DataFrame] = {}


def held_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_points numbered and stored once in a session, for what reads them more than once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _RAW:
        _RAW[key] = stored(raw_points(spark, sf_dir), "raw-points")
    return _RAW[key]


def points(spark: SparkSession, sf_dir: str, held: bool = False) -> DataFrame:
    """file_index, point_index, mx, my, z, classification."""
    at = decoded((held_points if held else raw_points)(spark, sf_dir))
    return at.select("file_index", "point_index", F.col("x").alias("mx"), F.col("y").alias("my"), "z", "classification")


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("camera_id"),
        F.col("user_id").alias("session_id"),
        "ts",
        F.expr("-15.45D + (user_id % 50) * 0.001D").alias("lng"),
        F.expr("28.10D + (event_id % 50) * 0.001D").alias("lat"),
        F.expr("cast(12 + event_id % 7 as double)").alias("zoom"),
        F.expr("cast((event_id * 13) % 86 as double)").alias("pitch"),
        F.expr("cast((user_id * 37) % 360 as double)").alias("bearing"),
        F.lit(900).alias("viewport_height"),
        F.lit(36.87).alias("fov_degrees"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera for each type of event, from sums over all events: few rows at any scale."""
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("user_id").alias("u"), F.sum("event_id").alias("e"), F.count(F.lit(1)).alias("n"))
    return sums.select(
        F.col("event_type").alias("camera_id"),
        F.expr("-15.45D + (u % 50) * 0.001D").alias("lng"),
        F.expr("28.10D + (e % 50) * 0.001D").alias("lat"),
        F.expr("cast(12 + n % 5 as double)").alias("zoom"),
        F.expr("cast((e * 13 + n) % 86 as double)").alias("pitch"),
        F.expr("cast((u * 37) % 360 as double)").alias("bearing"),
        F.lit(900).alias("viewport_height"),
        F.lit(36.87).alias("fov_degrees"),
    )
