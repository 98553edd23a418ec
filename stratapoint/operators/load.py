"""From points or LAS files to tiles, samples and full points in a store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapoint.config import Bounds, IndexConfig
from stratapoint.functions.camera import length
from stratapoint.functions.projection import metric_of_file, to_lnglat, valid_lnglat
from stratapoint.sources.las import headers, points_of
from stratapoint.sources.progress import reported
from stratapoint.sources.tiles import TileStore

from .sampling import of_every_level, sample_tops, settled, settled_counts, settled_samples
from .tiling import CRS_COLUMNS, Forest, leaf_points, pyramid, tile_records

CRS = tuple[str, int, int | None, bool | None, str]
#: The order that stands for chance.
SEED = 7
POINT = ["tile_id", "file_index", "depth", "point_index", "mx", "my", "z", "classification"]


@dataclass
class Index:
    """Tile records; the points of samples and of leaves, with tile_id and depth; the sample of the roots, unless not wanted; all of these points as a store takes them."""

    tiles: DataFrame
    samples: DataFrame
    full: DataFrame
    preview: DataFrame | None
    points: DataFrame


#: Points of a file in a part of its nested points, about, and parts of a file at most.
PART_POINTS, PARTS = 500_000, 256


def nested_points(points: DataFrame, bounds: Bounds | Forest, depth: int, size: int, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each point once, with its quadtree leaf's tile_id and `depth`, and `top`, the first level from which on the reservoirs of the tiles on its way hold it."""
    hashed = points.withColumn("_hash", F.md5(F.concat(F.lit(f"{SEED}:"), F.col("point_index").cast("string")).cast("binary")))
    return sample_tops(hashed, bounds, depth, size, "_hash", store).withColumn("depth", F.col("levels")).select(*POINT, "levels", "top")


def tile_samples(points: DataFrame, bounds: Bounds | Forest, depth: int, size: int, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A reservoir of each quadtree tile on every level, out of all points below it."""
    return of_every_level(nested_points(points, bounds, depth, size, store)).select(*POINT)


def in_parts(nested: DataFrame) -> DataFrame:
    """nested points as a store takes them, with `part`: a file's leaves are dealt over as many parts as its number of points asks for."""
    counts = nested.groupBy("file_index").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.least(F.ceil(F.col("_n") / PART_POINTS), F.lit(PARTS)).cast("int")
    rows = nested.join(counts, "file_index").withColumn("part", F.pmod(F.xxhash64("tile_id"), parts).cast("int"))
    return rows.select(*POINT, F.lit("nested").alias("kind"), "top", "part")


def build_index(
    points: DataFrame, mode: str, bounds: Bounds | Forest, config: IndexConfig, crs: CRS | None, store: Callable[[DataFrame, str], DataFrame], preview: bool = True
) -> Index:
    """mode "m3no" grows octrees with grid samples, any other quadtrees with reservoirs. points: file_index, point_index, mx, my, z, classification.

    One box and `crs` for all files, or a Forest. `store` materialises what later steps read again.
    """
    depth = bounds.depth if isinstance(bounds, Forest) else config.depth_for(bounds.diagonal)
    full = leaf_points(points, bounds, depth)
    full = full.withColumn("depth", F.size(F.split("tile_id", r"\.")) - 1).select(*POINT)
    if mode == "m3no":
        down = settled(points, bounds, depth, config.grid_cells, store)
        samples, counts = settled_samples(down, bounds, depth).select(*POINT), store(settled_counts(down, bounds, depth), "sample-counts")
    else:
        nested, counts = nested_points(points, bounds, depth, config.tile_sample_points, store), None
        samples = of_every_level(nested).select(*POINT)
    tiles = tile_records(pyramid(points, bounds, depth), bounds, depth, config, crs, counts)
    held = samples.withColumn("kind", F.lit("sample")).unionByName(full.withColumn("kind", F.lit("full"))) if mode == "m3no" else in_parts(nested)
    return Index(tiles, samples, full, samples.where("depth = 0") if preview else None, held)


def roots_of(headers: DataFrame, solid: bool, config: IndexConfig) -> DataFrame:
    """The root of each file from its header: box in the plane of its tiles (limits in order, an axis without extent widened by a centimetre each way) and depth."""
    kind = F.col("crs_kind")
    ends = {e: metric_of_file(F.col(f"{e}_x"), F.col(f"{e}_y"), kind) for e in ("min", "max")}
    rows = headers.select("file_index", *CRS_COLUMNS, *(ends[e][a].alias(f"_{e}_{a}") for e in ends for a in "xy"), F.col("min_z").alias("_min_z"), F.col("max_z").alias("_max_z"))
    sides = []
    for a in "xyz":
        low, high = F.least(f"_min_{a}", f"_max_{a}"), F.greatest(f"_min_{a}", f"_max_{a}")
        wide = F.when(low == high, 0.01).otherwise(0.0)
        rows = rows.withColumns({f"min_{a}": low - wide, f"max_{a}": high + wide})
        sides.append(F.col(f"max_{a}") - F.col(f"min_{a}"))
    if not solid:
        rows = rows.withColumns({f"{e}_z": F.lit(None).cast("double") for e in ("min", "max")})
    diagonal, depth = length(*sides[: 3 if solid else 2]), F.lit(config.max_depth)
    for k in range(config.max_depth - 1, -1, -1):
        depth = F.when(diagonal / 2**k <= config.min_diagonal, k).otherwise(depth)
    return rows.select("file_index", *(f"{e}_{a}" for a in "xyz" for e in ("min", "max")), depth.cast("int").alias("depth"), *CRS_COLUMNS)


def forest_of(headers: DataFrame, solid: bool, config: IndexConfig, store: Callable[[DataFrame, str], DataFrame]) -> Forest:
    roots = store(roots_of(headers, solid, config), "roots")
    files, depth = roots.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    return Forest(roots, depth, files, solid)


def placed(points: DataFrame) -> DataFrame:
    """Points of a LAS source with lng and lat, and mx and my in the plane of their tiles; those that cannot be projected are left out."""
    x, y, kind = F.col("x"), F.col("y"), F.col("crs_kind")
    at, m = to_lnglat(x, y, kind, F.col("crs_zone"), F.col("crs_northern")), metric_of_file(x, y, kind)
    rows = points.withColumns({"_at": at, "_m": m}).where(F.coalesce(valid_lnglat(F.col("_at.lng"), F.col("_at.lat")), F.lit(False)))
    return rows.select("file_index", "point_index", F.col("_at.lng").alias("lng"), F.col("_at.lat").alias("lat"), F.col("_m.x").alias("mx"), F.col("_m.y").alias("my"), "z", "classification")


def load_files(
    spark: SparkSession, paths: list[str], store: TileStore, mode: str, config: IndexConfig, scratch: Callable[[DataFrame, str], DataFrame],
    on_header: Callable[[dict], None] | None = None, on_progress: Callable[[int, str, int], None] | None = None,
    on_points: Callable[[str, int, int], None] | None = None,
) -> DataFrame:
    """Reads LAS files into the store, all in one plan, and returns a row of figures for each.

    Headers are read in tasks and reported, in order, before any point is. What the store held is replaced in one commit once all is
    written; a file that cannot be read, or has no point that can be projected, ends the load and leaves the store as it was.
    Times are those of the whole load, shared out by the files' points. on_progress gets file, step ("indexed", then "saved") and valid points of each file once its points are in the
    store, in order; on_points gets the step, the points it has done and all points while the job that reads them runs.
    """
    head = scratch(headers(spark, paths), "headers")
    if on_header:
        for row in head.orderBy("file_index").toLocalIterator():
            on_header(row.asDict())
    total = head.agg(F.coalesce(F.sum("whole_points"), F.lit(0))).first()[0]
    began = time.monotonic()
    with reported(spark, "read", total, on_points) as counter:
        points = scratch(placed(points_of(head, counter=counter)).drop("lng", "lat"), "points")
    counts = points.groupBy("file_index").agg(F.count(F.lit(1)).alias("valid_point_count"))
    counts = scratch(head.select("file_index", "path", "whole_points", *CRS_COLUMNS).join(counts, "file_index", "left").fillna(0, ["valid_point_count"]), "valid-counts")
    if empty := counts.where("valid_point_count = 0").orderBy("file_index").first():
        raise ValueError(f"no valid points in {empty.path}")
    read = time.monotonic()
    index = build_index(points, mode, forest_of(head, mode == "m3no", config, scratch), config, None, scratch)
    tiles = scratch(index.tiles, "tiles")
    indexed = time.monotonic()
    store.save(tiles, index.points)
    saved = time.monotonic()
    if on_progress:
        for row in counts.orderBy("file_index").toLocalIterator():
            for step in ("indexed", "saved"):
                on_progress(row.file_index, step, row.valid_point_count)
    part = F.col("whole_points") / max(1, total)
    spent = {f"{name}_ms": part * (1000 * (b - a)) for name, a, b in (("read", began, read), ("index", read, indexed), ("save", indexed, saved))}
    return counts.select(
        F.substring_index("path", "/", -1).alias("name"), "file_index", F.col("whole_points").alias("source_point_count"), "valid_point_count",
        *(c.alias(n) for n, c in spent.items()), "crs_kind", "crs_code", "crs_label",
    )


def grown_samples(samples: DataFrame, again: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The samples of a grown tree: those of the tiles that points reached, from `levels`, in place of the stored ones."""
    reached = levels[0].select("tile_id")
    for level in levels[1:]:
        reached = reached.union(level.select("tile_id"))
    return samples.join(reached.distinct(), "tile_id", "left_anti").unionByName(again)


def grown_counts(counts: DataFrame, again: DataFrame) -> DataFrame:
    """id, arrived and sampled of a grown tree: arrivals add up, a reached tile's sample counts anew."""
    both = counts.select("id", "arrived", "sampled", F.lit(0).alias("_load")).union(again.select("id", "arrived", "sampled", F.lit(1)))
    return both.groupBy("id").agg(F.sum("arrived").alias("arrived"), F.max_by("sampled", "_load").alias("sampled"))
