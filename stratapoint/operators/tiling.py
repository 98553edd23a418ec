"""Tile trees: paths of points, the pyramid of tiles, tile records and their outlines.

All leaves of a file lie at one depth, so a point's tile on every level follows from one string of digits. A
pyramid is a rollup over these digits, made from one row for each leaf. Bounds are halved level by level, as
a descent would, because multiplying them out rounds differently at cell borders.

Where `bounds` is asked for, one box may be given for all files, or a Forest: a root for each file, whose box and depth are
columns. Trees of any number of files then grow in one plan; a file's digits end (are null) below its own depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratapoint.config import Bounds, IndexConfig
from stratapoint.functions.camera import length
from stratapoint.functions.projection import to_lnglat, valid_lnglat, web_mercator_to_lnglat

AXES = ("x", "y", "z")


#: Files whose roots are sent to all tasks, at most; the roots of more files are joined as any other table.
SENT_ROOTS = 100_000
CRS_COLUMNS = ["crs_kind", "crs_code", "crs_zone", "crs_northern", "crs_label"]


@dataclass(frozen=True)
class Forest:
    """roots: file_index, min_x, min_y, max_x, max_y, min_z, max_z, depth and the columns CRS_COLUMNS of each file; depth: the greatest of theirs."""

    roots: DataFrame
    depth: int
    files: int
    solid: bool

    def of(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with columns of their file's root, an underscore before their names."""
        own = self.roots.select("file_index", *(F.col(c).alias(f"_{c}") for c in columns))
        return rows.join(F.broadcast(own) if self.files <= SENT_ROOTS else own, "file_index")


def digit_columns(depth: int) -> list[str]:
    return [f"d{level}" for level in range(1, depth + 1)]


def with_limits(df: DataFrame, bounds: Bounds | Forest) -> DataFrame:
    """df with the box of each row's root, an underscore before its names."""
    ends = [f"{end}_{a}" for a in AXES[: 3 if bounds.solid else 2] for end in ("min", "max")]
    if isinstance(bounds, Forest):
        return bounds.of(df, "depth", *ends)
    return df.withColumns({f"_{e}": F.lit(float(getattr(bounds, e))) for e in ends})


def _halved(axes, upper: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for a in axes:
        out[f"_min_{a}"] = F.when(upper[a], F.col(f"_mid_{a}")).otherwise(F.col(f"_min_{a}"))
        out[f"_max_{a}"] = F.when(upper[a], F.col(f"_max_{a}")).otherwise(F.col(f"_mid_{a}"))
    return out


def with_digits(points: DataFrame, bounds: Bounds | Forest, depth: int) -> DataFrame:
    """points (mx, my, z) with d1 to dn: 1 for the eastern half, 2 for the northern, 4 for the upper; a midpoint is in the larger half.

    Points outside the bounds go to the child at that edge.
    """
    axes = AXES[: 3 if bounds.solid else 2]
    column = {"x": F.col("mx"), "y": F.col("my"), "z": F.col("z")}
    df = with_limits(points, bounds)
    for name in digit_columns(depth):
        df = df.withColumns({f"_mid_{a}": (F.col(f"_min_{a}") + F.col(f"_max_{a}")) / 2 for a in axes})
        upper = {a: column[a] >= F.col(f"_mid_{a}") for a in axes}
        digit = sum((F.when(upper[a], 2**i).otherwise(0) for i, a in enumerate(axes)), F.lit(0)).cast("int")
        if isinstance(bounds, Forest):
            digit = F.when(F.col("_depth") >= int(name[1:]), digit)
        df = df.withColumns({name: digit, **_halved(axes, upper)})
    return df.drop("_depth", *(f"_{end}_{a}" for a in axes for end in ("min", "mid", "max")))


def root_name(bounds: Bounds | Forest) -> str:
    return "m3no" if bounds.solid else "r"


def tile_id(bounds: Bounds | Forest, digits: list[str], file_index: str = "file_index") -> Column:
    """<file>:<root>.<digit>...; digits that are null are left out."""
    root = F.concat(F.col(file_index).cast("string"), F.lit(f":{root_name(bounds)}"))
    return F.concat_ws(".", root, *(F.col(d).cast("string") for d in digits))


def with_bounds(tiles: DataFrame, bounds: Bounds | Forest, depth: int) -> DataFrame:
    """tiles (d1 to dn, null below a tile's depth) with their box, as the struct `bounds`.

    One fold over the digits: a filter on the box that is pushed down repeats an expression of fixed size.
    """
    axes = AXES[: 3 if bounds.solid else 2]
    none = F.lit(None).cast("double")
    tiles = with_limits(tiles, bounds)
    root = F.struct(*((F.col(f"_{end}_{a}") if a in axes else none).alias(f"{end}_{a}") for a in AXES for end in ("min", "max")))

    def half(box: Column, digit: Column) -> Column:
        ends = []
        for i, a in enumerate(AXES):
            low, high = box[f"min_{a}"], box[f"max_{a}"]
            upper, middle = digit.bitwiseAND(2**i) != 0, (low + high) / 2
            ends += [F.when(upper, middle).otherwise(low).alias(f"min_{a}"), F.when(upper, high).otherwise(middle).alias(f"max_{a}")]
        return F.when(digit.isNull(), box).otherwise(F.struct(*ends))

    digits = [F.col(d) for d in digit_columns(depth)]
    out = tiles.withColumn("bounds", F.aggregate(F.array(*digits), root, half) if digits else root)
    return out.drop("_depth", *(f"_{end}_{a}" for a in axes for end in ("min", "max")))


def with_bounds_of_points(points: DataFrame, bounds: Bounds | Forest, depth: int) -> DataFrame:
    """The same for points that all have `depth` digits, in projections that Spark compiles."""
    axes = AXES[: 3 if bounds.solid else 2]
    df = with_limits(points, bounds)
    for name in digit_columns(depth):
        df = df.withColumns({f"_mid_{a}": (F.col(f"_min_{a}") + F.col(f"_max_{a}")) / 2 for a in axes})
        df = df.withColumns(_halved(axes, {a: F.col(name).bitwiseAND(2**i) != 0 for i, a in enumerate(axes)}))
    none = F.lit(None).cast("double")
    ends = [(F.col(f"_{end}_{a}") if a in axes else none).alias(f"{end}_{a}") for a in AXES for end in ("min", "max")]
    return df.withColumn("bounds", F.struct(*ends)).drop("_depth", *(f"_{end}_{a}" for a in axes for end in ("min", "mid", "max")))


#: A set of classes, numbers of eight bits, is four numbers of 64 bits: sets unite by OR in constant space.
MASKS = ("_kinds0", "_kinds1", "_kinds2", "_kinds3")


def class_masks(classification: str = "classification") -> list[Column]:
    """Aggregates: the classes of a group, as the columns MASKS."""
    own = [F.expr(f"CASE WHEN {classification} BETWEEN {64 * k} AND {64 * k + 63} THEN shiftleft(1L, {classification} - {64 * k}) ELSE 0L END") for k in range(4)]
    return [F.bit_or(m).alias(name) for m, name in zip(own, MASKS)]


def classes_of() -> Column:
    """The classes of the columns MASKS, in order."""
    parts = (f"transform(filter(sequence(0, 63), x -> (shiftright({m}, x) & 1L) = 1L), x -> x + {64 * k})" for k, m in enumerate(MASKS))
    return F.expr(f"concat({', '.join(parts)})")


def pyramid(points: DataFrame, bounds: Bounds | Forest, depth: int) -> DataFrame:
    """A row for each tile that holds points: id, parent_id, depth, digits, count, heights, first point and classes.

    points: file_index, point_index, mx, my, z, classification. The rollup reads one row for each leaf, and what it sums has a fixed size.
    """
    digits = digit_columns(depth)
    leaves = with_digits(points, bounds, depth).groupBy("file_index", *digits).agg(
        F.count(F.lit(1)).alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.min("point_index").alias("first"), *class_masks()
    )
    rolled = leaves.rollup("file_index", *digits).agg(
        F.sum("n").alias("full_count"),
        F.min("lo").alias("min_z"),
        F.max("hi").alias("max_z"),
        F.min("first").alias("first_point"),
        *(F.bit_or(m).alias(m) for m in MASKS),
        F.bit_count(F.grouping_id()).alias("_rolled"),
    )
    at = sum((F.col(d).isNotNull().cast("int") for d in digits), F.lit(0))
    # A file of fewer levels has null digits; only the row that rolls all of them up is a tile.
    tiles = rolled.where((F.col("file_index").isNotNull()) & (at == depth - F.col("_rolled"))).withColumn("classes", classes_of())
    at = at.alias("depth")
    ident = tile_id(bounds, digits)
    parent = F.when(F.col(digits[0]).isNotNull(), F.regexp_replace(ident, r"\.\d$", "")) if digits else F.lit(None).cast("string")
    return tiles.select(ident.alias("id"), parent.alias("parent_id"), "file_index", at, *digits, "full_count", "min_z", "max_z", "first_point", "classes")


def children(tiles: DataFrame) -> DataFrame:
    """id and child_ids of each tile that has children, in the order in which their first points came."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("first_point").alias("f"), F.col("id").alias("i"))))
    out = tiles.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(listed.alias("c"))  # eight at most
    return out.select("id", F.transform("c", lambda c: c["i"]).alias("child_ids"))


def corners(bounds: Column, kind: Column, zone: Column, northern: Column) -> Column:
    """South-west, south-east, north-east and north-west as [lng, lat]; corners that cannot be projected are left out."""
    at = [(bounds[f"{x}_x"], bounds[f"{y}_y"]) for x, y in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"))]
    placed = F.array(*(F.when(kind == "geographic", web_mercator_to_lnglat(x, y)).otherwise(to_lnglat(x, y, kind, zone, northern)) for x, y in at))
    return F.transform(F.filter(placed, lambda p: valid_lnglat(p["lng"], p["lat"])), lambda p: F.array(p["lng"], p["lat"]))


def center(bounds: Column, kind: Column, zone: Column, northern: Column) -> Column:
    x, y = (bounds["min_x"] + bounds["max_x"]) / 2, (bounds["min_y"] + bounds["max_y"]) / 2
    return F.when(kind == "geographic", web_mercator_to_lnglat(x, y)).otherwise(to_lnglat(x, y, kind, zone, northern))


def tile_records(
    tiles: DataFrame, bounds: Bounds | Forest, depth: int, config: IndexConfig, crs: tuple[str, int, int | None, bool | None, str] | None = None, samples: DataFrame | None = None
) -> DataFrame:
    """Metadata of tiles from a pyramid. crs: kind, code, zone, northern, label of the files, where bounds is no Forest.

    Without `samples` the tree is a quadtree: a tile's own count is that of its volume, only leaves hold full points, and a
    sample has `tile_sample_points` at most. samples (id, arrived, sampled) makes it an octree: inner tiles then count
    what arrived at them, and every tile counts its volume as full.
    """
    tiles = with_bounds(tiles, bounds, depth).join(children(tiles), "id", "left")
    if isinstance(bounds, Forest):
        tiles = bounds.of(tiles, "depth", *CRS_COLUMNS)
    else:
        own = zip(CRS_COLUMNS, crs, ("string", "int", "int", "boolean", "string"))
        tiles = tiles.withColumns({"_depth": F.lit(depth), **{f"_{c}": F.lit(v).cast(t) for c, v, t in own}})
    child_ids = F.coalesce("child_ids", F.array().cast("array<string>"))
    if samples is None:
        leaf = F.col("depth") == F.col("_depth")
        counts = tiles.withColumns({
            "original_point_count": F.col("full_count"),
            "full_point_count": F.when(leaf, F.col("full_count")).otherwise(F.lit(0)).cast("long"),
            "sampled_point_count": F.least("full_count", F.lit(config.tile_sample_points)).cast("long"),
        })
        counts = counts.withColumn("point_count", F.greatest("sampled_point_count", "full_point_count"))
    else:
        counts = tiles.join(samples, "id", "left").withColumns({
            "original_point_count": F.coalesce("arrived", F.lit(0)).cast("long"),
            "full_point_count": F.col("full_count"),
            "sampled_point_count": F.coalesce("sampled", F.lit(0)).cast("long"),
            "point_count": F.col("full_count"),
        })
    kind, code, zone, northern, label = (F.col(f"_{c}") for c in CRS_COLUMNS)
    b = F.col("bounds")
    low, high = F.coalesce(b["min_z"], "min_z"), F.coalesce(b["max_z"], "max_z")
    zone_map = F.struct(F.struct(F.col("min_z").alias("min"), F.col("max_z").alias("max")).alias("altitude"), F.col("classes").alias("classification_bins"))
    return counts.select(
        "id", "parent_id", child_ids.alias("child_ids"), "file_index", label.alias("crs_label"), kind.alias("crs_kind"),
        code.cast("int").alias("crs_code"), zone.cast("int").alias("crs_zone"), northern.alias("crs_northern"), "depth", "bounds",
        length(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"], high - low).alias("diagonal_meters"),
        "original_point_count", "full_point_count", F.greatest("original_point_count", "full_point_count", "point_count").alias("source_point_count"),
        "point_count", "sampled_point_count", (zone_map if samples is not None else F.lit(None).cast("struct<altitude:struct<min:double,max:double>,classification_bins:array<int>>")).alias("attribute_indexes"),
        center(b, kind, zone, northern).alias("center"), corners(b, kind, zone, northern).alias("corners"), "min_z", "max_z",
    )


def leaf_points(points: DataFrame, bounds: Bounds | Forest, depth: int) -> DataFrame:
    """points with tile_id, the leaf that holds each in full."""
    digits = digit_columns(depth)
    return with_digits(points, bounds, depth).withColumn("tile_id", tile_id(bounds, digits)).drop(*digits)
