"""Figures and reports of a loaded cloud, its bounds, and the camera that shows all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratapoint.config import IndexConfig, LodConfig
from stratapoint.functions import labels
from stratapoint.functions.camera import zoom_for_altitude

#: Fixed value: where to look when there are no points.
DEFAULT_CENTER = (-15.4363, 28.1235)


def lnglat_bounds(tiles: DataFrame) -> DataFrame:
    """One row: the box of all tile corners, null without corners."""
    at = tiles.select(F.explode("corners").alias("c"))
    lng, lat = F.col("c")[0], F.col("c")[1]
    return at.agg(F.min(lng).alias("min_lng"), F.max(lng).alias("max_lng"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"))


def cloud_stats(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """One row. files: name, source_point_count, valid_point_count, read_ms, index_ms, save_ms, crs_kind, crs_code, crs_label."""
    leaf = F.size("child_ids") <= 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    per_tile = tiles.agg(
        F.count(F.lit(1)).alias("tile_count"),
        zero(F.max("source_point_count")).alias("max_points_per_node"),
        F.coalesce(F.avg("source_point_count"), F.lit(0.0)).alias("average_points_per_node"),
        zero(F.max("sampled_point_count")).alias("max_sampled_points_per_node"),
        zero(F.max(F.when(leaf, F.col("full_point_count")))).alias("max_full_points_per_leaf"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_point_count", "valid_point_count", "read_ms", "index_ms", "save_ms")]
    sets = [F.concat_ws(", ", F.array_sort(F.collect_set(c))).alias(n) for c, n in ((F.col("crs_kind"), "crs_kinds"), (F.concat(F.lit("EPSG:"), F.col("crs_code").cast("string")), "crs_codes"))]
    per_file = files.agg(F.count(F.lit(1)).alias("file_count"), *sums, *sets, F.collect_set("crs_label").alias("_labels"))
    out = per_file.crossJoin(per_tile).crossJoin(lnglat_bounds(tiles))  # one row each
    summary = F.when(F.size("_labels") == 1, F.col("_labels")[0]).otherwise(F.concat(F.size("_labels").cast("string"), F.lit(" coordinate systems")))
    rate = F.when(F.col("index_ms") > 0, F.col("valid_point_count") / (F.nullif(F.col("index_ms"), F.lit(0)) / 1000)).otherwise(0.0)
    return out.withColumns({"crs_summary": summary, "points_per_second": rate}).drop("_labels")


def progressive_valid(tiles: DataFrame) -> DataFrame:
    """One row while files still load: valid points are those of the roots."""
    return tiles.where("parent_id IS NULL").agg(F.sum(F.greatest("original_point_count", "full_point_count", "point_count")).alias("valid_point_count"))


def report(stats: DataFrame, mode: Column, active: Column, rendered: Column, visible: Column, config: IndexConfig, lod: LodConfig) -> DataFrame:
    """The one row of cloud_stats as rows (position, section, label, value)."""
    c = F.col
    lines = [
        ("Structure", "Type", mode),
        ("Structure", "Files", labels.integer(c("file_count"))),
        ("Structure", "Nodes", labels.integer(c("tile_count"))),
        ("Structure", "Active nodes", labels.integer(active)),
        ("LOD", "Angular threshold", F.concat(labels.number(F.lit(float(lod.threshold_degrees)), 2), F.lit(" deg"))),
        ("LOD", "Hysteresis", F.concat(labels.number(F.lit(lod.hysteresis * 100.0), 0), F.lit("%"))),
        ("LOD", "Min node diagonal", F.concat(labels.integer(F.lit(float(config.min_diagonal))), F.lit(" m"))),
        ("LOD", "Max tree depth", labels.integer(F.lit(config.max_depth))),
        ("Points", "LAS points", labels.integer(c("source_point_count"))),
        ("Points", "Valid projected", labels.integer(c("valid_point_count"))),
        ("Points", "Rendered now", labels.integer(rendered)),
        ("Points", "Visible source", labels.integer(visible)),
        ("Points", "Max / node", labels.integer(c("max_points_per_node"))),
        ("Points", "Avg / node", labels.number(c("average_points_per_node"), 1)),
        ("Points", "Max sampled / node", labels.integer(c("max_sampled_points_per_node"))),
        ("Points", "Max full / leaf", labels.integer(c("max_full_points_per_leaf"))),
        ("Projection", "CRS", c("crs_summary")),
        ("Projection", "Kinds", F.coalesce(F.nullif("crs_kinds", F.lit("")), F.lit("-"))),
        ("Projection", "EPSG", F.coalesce(F.nullif("crs_codes", F.lit("")), F.lit("-"))),
        ("Timing", "Total", labels.duration(c("read_ms") + c("index_ms") + c("save_ms"))),
        ("Timing", "Read", labels.duration(c("read_ms"))),
        ("Timing", "Index", labels.duration(c("index_ms"))),
        ("Timing", "Store", labels.duration(c("save_ms"))),
        ("Timing", "Rate", F.concat(labels.number(c("points_per_second"), 2), F.lit(" pts/s"))),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("section"), F.lit(n).alias("label"), v.cast("string").alias("value")) for i, (s, n, v) in enumerate(lines)))
    return stats.select(F.inline(rows))


def status_line(mode: Column, files: Column, active: Column, tiles: Column, rendered: Column, available: Column, crs: Column) -> Column:
    noun = F.when(files == 1, " file - ").otherwise(" files - ")
    parts = [mode, F.lit(" - "), files.cast("string"), noun, labels.integer(active), F.lit(" active / "), labels.integer(tiles), F.lit(" tiles - "), labels.integer(rendered)]
    return F.concat(*parts, F.lit(" sampled points rendered from "), labels.integer(available), F.lit(" source points - "), crs)


def point_center(points: DataFrame) -> DataFrame:
    """One row: the middle of the points' lng/lat box, or a default place without points."""
    mid = lambda c, d: F.coalesce((F.min(c) + F.max(c)) / 2, F.lit(d))
    return points.agg(mid("lng", DEFAULT_CENTER[0]).alias("lng"), mid("lat", DEFAULT_CENTER[1]).alias("lat"))


def fly_to(tiles: DataFrame, clearance: float = 1000.0, pitch: float = 65.0) -> DataFrame:
    """One row: a camera above the whole cloud."""
    target = min(max(pitch, 65.0), 85.0)
    top = tiles.agg(F.greatest(F.coalesce(F.max("max_z"), F.lit(0.0)), F.lit(0.0)).alias("top"), F.greatest(F.coalesce(F.max("diagonal_meters"), F.lit(0.0)), F.lit(clearance)).alias("wide"))
    both = lnglat_bounds(tiles).where("min_lng IS NOT NULL").crossJoin(top)  # one row each
    lat = (F.col("min_lat") + F.col("max_lat")) / 2
    both = both.select(
        ((F.col("min_lng") + F.col("max_lng")) / 2).alias("lng"), lat.alias("lat"), (F.col("top") + F.greatest(F.col("wide") * 0.7, F.lit(clearance))).alias("altitude")
    )
    return both.select("lng", "lat", "altitude", F.lit(target).alias("pitch"), F.lit(-18.0).alias("bearing"), zoom_for_altitude(F.col("lat"), F.col("altitude"), F.lit(target)).alias("zoom"))
