"""The engine's queries, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files, small  # noqa: F401  (they register their queries)
from .queries import ORACLES, QUERIES, _picked

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles are active for each camera, with how many points, and how wide they look."""
    active = _picked(spark, sf_dir).where("active")
    return active.select("camera_id", F.col("id").alias("tile_id"), "depth", "point_count", F.round("angle", 4).alias("angle"))
