"""Shapes for display: tile outlines as GeoJSON, boxes as line segments, points relative to an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratapoint.functions.camera import vertical_bounds
from stratapoint.functions.labels import CLASSES, OTHER_CLASS
from stratapoint.functions.projection import to_lnglat, valid_lnglat, web_mercator_to_lnglat

#: Corners 0 to 3 below and 4 to 7 above, both from south-west round by the east; edges join neighbours.
EDGES = [(i + base, (i + 1) % 4 + base) for base in (0, 4) for i in range(4)] + [(i, i + 4) for i in range(4)]


def outlines(tiles: DataFrame, label: Column) -> DataFrame:
    """id and feature, a GeoJSON polygon, of each tile with points and four corners."""
    ring = F.concat("corners", F.slice("corners", 1, 1))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("id"), F.col("point_count").alias("pointCount"), label.alias("detailLabel")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return tiles.where((F.size("corners") == 4) & (F.col("point_count") > 0)).select("id", F.to_json(feature).alias("feature"))


def boxes(tiles: DataFrame, exaggeration: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The twelve edges of each tile's box in lng, lat and height; tiles with a corner that cannot be projected have none."""
    b = F.col("bounds")
    low, high = vertical_bounds(b, F.col("min_z"), F.col("max_z"))
    around = [("min", "min"), ("max", "min"), ("max", "max"), ("min", "max")]
    corners = []
    for height in (low, high):
        for ex, ey in around:
            x, y = b[f"{ex}_x"], b[f"{ey}_y"]
            at = F.when(F.col("crs_kind") == "geographic", web_mercator_to_lnglat(x, y)).otherwise(to_lnglat(x, y, F.col("crs_kind"), F.col("crs_zone"), F.col("crs_northern")))
            corners.append(F.struct(at["lng"].alias("lng"), at["lat"].alias("lat"), (height * exaggeration + offset).alias("height")))
    placed = tiles.select("id", F.array(*corners).alias("c")).where(F.forall("c", lambda p: F.coalesce(valid_lnglat(p["lng"], p["lat"]), F.lit(False))))
    edges = F.array(*(F.struct(F.lit(i).alias("edge"), F.col("c")[a].alias("a"), F.col("c")[z].alias("b")) for i, (a, z) in enumerate(EDGES)))
    out = placed.select("id", F.inline(edges))
    return out.select("id", "edge", *(F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in "ab" for c in ("lng", "lat", "height")))


def unit_mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator scaled to a square of side one, from the north-west."""
    y = F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483))
    return (lng + 180.0) / 360.0, F.lit(0.5) - y / 6.283185307179586


def render_positions(points: DataFrame, tile: str = "tile_id", exaggeration: float = 1.0, offset: float = 0.0) -> DataFrame:
    """points (lng, lat, z) with x and y relative to their tile's anchor, the middle of its box, so that single precision is enough."""
    height = F.when(F.col("z").isNotNull() & ~F.isnan("z"), F.col("z") * exaggeration + offset).otherwise(offset)
    rows = points.withColumn("height", height)
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    anchors = rows.groupBy(tile).agg(mid("lng").alias("_lng"), mid("lat").alias("_lat"), mid("height").alias("anchor_height"))
    x, y = unit_mercator(F.col("lng"), F.col("lat"))
    ax, ay = unit_mercator(F.col("_lng"), F.col("_lat"))
    return rows.join(anchors, tile).withColumns({"rel_x": (x - ax).cast("float"), "rel_y": (y - ay).cast("float")}).drop("_lng", "_lat")


def box_anchor(edges: DataFrame, by: list[str]) -> DataFrame:
    """The mean place of the corners of boxes (as `boxes` gives them): every corner ends three edges, so that the ends' mean is theirs."""
    x, y = unit_mercator(F.col("c.lng"), F.col("c.lat"))
    ends = edges.select(*by, F.explode(F.array(*(F.struct(*(F.col(f"{end}_{c}").alias(c) for c in ("lng", "lat", "height"))) for end in "ab"))).alias("c"))
    return ends.groupBy(*by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg("c.height").alias("height"))


def transformed(matrix: list[float], x: Column, y: Column, z: Column) -> Column:
    """A 4 x 4 matrix, column by column, times a point, in single precision; coordinates that are null count as 0."""
    at = [F.coalesce(c, F.lit(0.0)) for c in (x, y, z)]
    rows = [sum((at[c] * float(matrix[4 * c + r]) for c in range(3)), F.lit(0.0)) + float(matrix[12 + r]) for r in range(4)]
    return F.array(*(v.cast("float") for v in rows))


def with_terrain(points: DataFrame, terrain: DataFrame, cell: float) -> DataFrame:
    """points (mx, my) with `elevation` of the terrain cell (cell_x, cell_y, elevation) below each, 0 where there is none."""
    keyed = points.withColumns({"_cx": F.floor(F.col("mx") / cell), "_cy": F.floor(F.col("my") / cell)})
    ground = terrain.select(F.col("cell_x").alias("_cx"), F.col("cell_y").alias("_cy"), "elevation")
    return keyed.join(ground, ["_cx", "_cy"], "left").withColumn("elevation", F.coalesce("elevation", F.lit(0.0))).drop("_cx", "_cy")


def legend(spark) -> DataFrame:
    """Every class with its colour from 0 to 255, the fallback last."""
    rows = [(i, str(k), n, *(c * 255 for c in rgb[:3]), rgb[3]) for i, (k, n, rgb) in enumerate(CLASSES)]
    rows.append((len(rows), "Other", "Other classifications", *(c * 255 for c in OTHER_CLASS[1][:3]), OTHER_CLASS[1][3]))
    return spark.createDataFrame(rows, "position int, code string, label string, red double, green double, blue double, alpha double")


def legend_of(points: DataFrame) -> DataFrame:
    """The legend with the number of points of each of its rows."""
    listed = F.col("classification").isin([k for k, _, _ in CLASSES])
    counts = points.groupBy("classification").agg(F.count(F.lit(1)).alias("_n"))  # 256 classes at most
    counts = counts.groupBy(F.when(listed, F.col("classification").cast("string")).otherwise("Other").alias("code")).agg(F.sum("_n").alias("points"))
    return legend(points.sparkSession).join(counts, "code", "left").fillna(0, ["points"])


def class_table(spark) -> DataFrame:
    """The fixed classes: classification, label, red, green, blue, alpha."""
    return spark.createDataFrame([(k, n, *map(float, c)) for k, n, c in CLASSES], "classification int, label string, red double, green double, blue double, alpha double")


def coloured(points: DataFrame, classes: DataFrame) -> DataFrame:
    """points with the label and colour of their class, or of the fallback. Of the class table the first 32 rows by class count."""
    out = points.join(F.broadcast(classes.orderBy("classification").limit(32)), "classification", "left")
    other = dict(zip(("red", "green", "blue", "alpha"), OTHER_CLASS[1]))
    return out.withColumns({"label": F.coalesce("label", F.lit(OTHER_CLASS[0])), **{k: F.coalesce(k, F.lit(v)) for k, v in other.items()}})
