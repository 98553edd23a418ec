"""One query for each operator of the engine, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratapoint.functions import camera as cam, crs, labels, projection as pr
from stratapoint.operators import geometry, payload, sampling, selection, stats, tiling
from stratapoint.plans import cloud, oracles as o
from stratapoint.sources.scratch import stored
from stratapoint.sources.tiles import latest
from stratapoint.streaming.progress import debounced, progressive_tiles, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GRID_DEPTH, GRID_CELLS = 3, 4


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


def joined(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_TILES: dict[tuple[str, str], DataFrame] = {}


def quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadtree's records, stored once in a session, as a load does; queries read the table."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TILES:
        tiles = tiling.pyramid(cloud.points(spark, sf_dir, held=True), cloud.FLAT, cloud.DEPTH)
        _TILES[key] = stored(tiling.tile_records(tiles, cloud.FLAT, cloud.DEPTH, cloud.CONFIG, cloud.CRS), "quadtree")
    return _TILES[key]


_SETTLED: dict[tuple, DataFrame] = {}


def settled(spark: SparkSession, sf_dir: str, depth: int = cloud.DEPTH, cells: int = cloud.CONFIG.grid_cells) -> DataFrame:
    """Where each point of the octree's samples ends, stored once in a session."""
    key = spark.sparkContext.applicationId, sf_dir, depth, cells
    if key not in _SETTLED:
        _SETTLED[key] = sampling.settled(cloud.points(spark, sf_dir, held=True), cloud.SOLID, depth, cells, stored)
    return _SETTLED[key]


def octo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The octree's records with what arrived at each tile and what its sample keeps, stored once in a session."""
    key = spark.sparkContext.applicationId, f"{sf_dir}#octree"
    if key not in _TILES:
        counts = stored(sampling.settled_counts(settled(spark, sf_dir), cloud.SOLID, cloud.DEPTH), "sample-counts")
        tiles = tiling.pyramid(cloud.points(spark, sf_dir, held=True), cloud.SOLID, cloud.DEPTH)
        _TILES[key] = stored(tiling.tile_records(tiles, cloud.SOLID, cloud.DEPTH, cloud.CONFIG, cloud.CRS, counts), "octree")
    return _TILES[key]


# Points and projections


@query(o.with_(o.POINTS, final="SELECT file_index, point_index, x, y, z, classification FROM points"))
def q_point_decode(spark, sf_dir):
    return cloud.decoded(cloud.raw_points(spark, sf_dir)).select("file_index", "point_index", "x", "y", "z", "classification")


@query(o.with_(o.POINTS, o.inverse("points", "ll"), final="SELECT count(*) AS n, count(*) FILTER (WHERE abs(lng) <= 180 AND abs(lat) <= 90) AS valid FROM ll"))
def q_valid_points(spark, sf_dir):
    rows = pr.with_lnglat(cloud.points(spark, sf_dir), F.col("mx"), F.col("my"), 28)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(pr.valid_lnglat(F.col("lng"), F.col("lat"))).alias("valid"))


@query(o.with_(o.RAW, final="SELECT classification, count(*) AS n FROM raw GROUP BY 1"))
def q_class_histogram(spark, sf_dir):
    return cloud.raw_points(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query(o.with_(o.RAW, final="SELECT file_index, count(*) AS n, sum(raw_x) AS sx, sum(raw_y) AS sy FROM raw GROUP BY 1"))
def q_multi_file_union(spark, sf_dir):
    points = cloud.raw_points(spark, sf_dir)
    both = points.where("file_index = 0").unionByName(points.where("file_index = 1"))
    return both.groupBy("file_index").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_x").alias("sx"), F.sum("raw_y").alias("sy"))


@query(o.with_(o.POINTS, o.inverse("points", "ll"), final="SELECT file_index, point_index, round(lng, 6) AS lng, round(lat, 6) AS lat, z AS altitude, x AS mx, y AS my FROM ll"))
def q_project_points(spark, sf_dir):
    kind, zone, north = F.lit("utm"), F.lit(28), F.lit(True)
    rows = cloud.decoded(cloud.raw_points(spark, sf_dir))
    at, metric = pr.to_lnglat(F.col("x"), F.col("y"), kind, zone, north), pr.metric_of_file(F.col("x"), F.col("y"), kind)
    rows = rows.select("file_index", "point_index", "z", at.alias("at"), metric.alias("m"))
    return rows.select("file_index", "point_index", r6(F.col("at.lng")).alias("lng"), r6(F.col("at.lat")).alias("lat"), F.col("z").alias("altitude"), F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


@query(o.with_(o.POINTS, o.inverse("points", "ll"), final="SELECT point_index, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ll"))
def q_utm_to_lnglat(spark, sf_dir):
    rows = pr.with_lnglat(cloud.points(spark, sf_dir), F.col("mx"), F.col("my"), 28)
    return rows.select("point_index", r6(F.col("lng")).alias("lng"), r6(F.col("lat")).alias("lat"))


@query(o.with_(o.EVENT_CAMERAS, o.forward("cams", "fw"), final="SELECT camera_id, round(ux, 4) AS x, round(uy, 4) AS y FROM fw"))
def q_lnglat_to_utm(spark, sf_dir):
    rows = cloud.camera_events(spark, sf_dir).select("camera_id", pr.lnglat_to_utm(F.col("lng"), F.col("lat"), 28).alias("m"))
    return rows.select("camera_id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


@query(o.with_(
    o.EVENT_CAMERAS,
    "m AS (SELECT camera_id, radians(lng) * 6378137 AS x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM cams)",
    final="SELECT camera_id, round(x, 4) AS x, round(y, 4) AS y, round(degrees(x / 6378137), 6) AS lng, round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 6) AS lat FROM m",
))
def q_web_mercator(spark, sf_dir):
    rows = cloud.camera_events(spark, sf_dir).select("camera_id", pr.web_mercator(F.col("lng"), F.col("lat")).alias("m"))
    back = pr.web_mercator_to_lnglat(F.col("m.x"), F.col("m.y"))
    return rows.select("camera_id", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"), r6(back["lng"]).alias("lng"), r6(back["lat"]).alias("lat"))


@query(o.with_(
    o.EVENT_CAMERAS,
    "h AS (SELECT camera_id, pow(sin(radians(28.1235 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(28.1235)) * pow(sin(radians(-15.4363 - lng) / 2), 2) AS h FROM cams)",
    final="SELECT camera_id, round(6371008.8 * 2 * asin(sqrt(h)), 3) AS metres FROM h",
))
def q_haversine(spark, sf_dir):
    home = (F.lit(stats.DEFAULT_CENTER[0]), F.lit(stats.DEFAULT_CENTER[1]))
    return cloud.camera_events(spark, sf_dir).select("camera_id", F.round(pr.haversine(F.col("lng"), F.col("lat"), *home), 3).alias("metres"))


PLACES = {
    "x": "case c_custkey % 4 when 0 then -15.45 + (c_custkey % 50) * 0.001 when 1 then -1720000.0 + c_custkey % 900 else 456000.0 + c_custkey % 900 end",
    "y": "case c_custkey % 4 when 0 then 28.1 + (c_custkey % 70) * 0.001 when 1 then 3260000.0 + c_custkey % 700 when 2 then 3110000.0 + c_custkey % 700 else 6890000.0 + c_custkey % 700 end",
}
KIND = "case c_custkey % 4 when 0 then 'geographic' when 1 then 'web-mercator' else 'utm' end"
MERCATOR_X, MERCATOR_Y = "radians(lng) * 6378137", "6378137 * ln(tan(pi() / 4 + radians(lat) / 2))"


@query(o.with_(f"places AS (SELECT c_custkey, {KIND} AS kind, c_custkey % 4 AS k, ({PLACES['x']})::DOUBLE AS x, ({PLACES['y']})::DOUBLE AS y FROM customer)",
  "shifted AS (SELECT c_custkey, kind, k, x AS gx, y AS gy, x, CASE WHEN k = 3 THEN y - 10000000 ELSE y END AS y FROM places)", o.inverse("shifted", "u"),
  "w AS (SELECT c_custkey, kind, k, gx, gy, CASE k WHEN 0 THEN gx WHEN 1 THEN degrees(gx / 6378137) ELSE lng END AS lng, CASE k WHEN 0 THEN gy WHEN 1 THEN degrees(2 * atan(exp(gy / 6378137)) - pi() / 2) ELSE lat END AS lat FROM u)",
  o.forward("w", "fw"),
  final=f"""SELECT c_custkey, round(lng, 6) AS lng, round(lat, 6) AS lat, round(CASE k WHEN 0 THEN {MERCATOR_X} ELSE gx END, 2) AS mx, round(CASE k WHEN 0 THEN {MERCATOR_Y} ELSE gy END, 2) AS my,
  round(CASE WHEN k >= 2 THEN ux ELSE {MERCATOR_X} END, 2) AS back_x, round(CASE WHEN k = 3 THEN uy + 10000000 WHEN k = 2 THEN uy ELSE {MERCATOR_Y} END, 2) AS back_y FROM fw"""))  # fmt: skip
def q_project_kinds(spark, sf_dir):
    """Degrees, Mercator metres, and UTM of both hemispheres: to degrees, to the tiles' plane, and from degrees back to it."""
    kind, zone, north = F.expr(KIND), F.when(F.expr("c_custkey % 4 >= 2"), 28), F.expr("c_custkey % 4 <> 3")
    rows = cloud.table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), zone.alias("zone"), north.alias("north"), *(F.expr(PLACES[a]).cast("double").alias(a) for a in "xy"))
    c = F.col
    rows = rows.withColumns({"at": pr.to_lnglat(c("x"), c("y"), c("kind"), c("zone"), c("north")), "m": pr.metric_of_file(c("x"), c("y"), c("kind"))})
    rows = rows.withColumn("back", pr.to_metric(c("at.lng"), c("at.lat"), c("kind"), c("zone"), c("north")))
    two = {"mx": "m.x", "my": "m.y", "back_x": "back.x", "back_y": "back.y"}
    return rows.select("c_custkey", r6(c("at.lng")).alias("lng"), r6(c("at.lat")).alias("lat"), *(F.round(v, 2).alias(k) for k, v in two.items()))


# Coordinate reference systems

CODES_SQL = "codes AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 4326 WHEN p_partkey % 4 = 1 THEN 3857 WHEN p_partkey % 4 = 2 THEN 32601 + p_partkey % 160 ELSE 25801 + p_partkey % 70 END::INT AS code FROM part)"


def codes(spark, sf_dir):
    expr = "cast(case when p_partkey % 4 = 0 then 4326 when p_partkey % 4 = 1 then 3857 when p_partkey % 4 = 2 then 32601 + p_partkey % 160 else 25801 + p_partkey % 70 end as int)"
    return cloud.table(spark, sf_dir, "part").select("p_partkey", F.expr(expr).alias("code"))


IS_UTM = "({c} BETWEEN 32601 AND 32660 OR {c} BETWEEN 32701 AND 32760 OR {c} BETWEEN 25801 AND 25860)"


@query(o.with_(CODES_SQL, final=f"""SELECT p_partkey, code,
  CASE WHEN code = 4326 THEN 'geographic' WHEN code = 3857 THEN 'web-mercator' WHEN {IS_UTM.format(c='code')} THEN 'utm' END AS kind,
  CASE WHEN {IS_UTM.format(c='code')} THEN code % 100 END AS zone, CASE WHEN {IS_UTM.format(c='code')} THEN code < 32700 END AS northern,
  CASE WHEN code IN (4326, 3857) THEN 'EPSG:' || code || ' (WKT)'
    WHEN {IS_UTM.format(c='code')} THEN 'EPSG:' || code || ' UTM zona ' || code % 100 || CASE WHEN code < 32700 THEN 'N' ELSE 'S' END || ' (WKT)' END AS label FROM codes"""))  # fmt: skip
def q_crs_from_epsg(spark, sf_dir):
    rows = codes(spark, sf_dir).withColumn("c", crs.crs_of(F.col("code"), "WKT"))
    return rows.select("p_partkey", "code", "c.kind", "c.zone", "c.northern", "c.label")


WKT = "concat('PROJCS[\"', p_name, '\",AUTHORITY[\"EPSG\",\"', cast(7030 as {s}), '\"],ID[\"', cast(code as {s}), '\"],', cast(p_size * 1000 as {s}), ']')"


@query(o.with_(CODES_SQL, f"t AS (SELECT p_partkey, {WKT.format(s='VARCHAR')} AS wkt FROM codes JOIN part USING (p_partkey))",
  "f AS (SELECT p_partkey, list_transform(regexp_extract_all(wkt, '[0-9]{4,5}'), lambda x: x::INT) AS cs FROM t)", final=f"""SELECT p_partkey,
  coalesce(list_filter(cs, lambda x: {IS_UTM.format(c='x')})[1], list_filter(cs, lambda x: x IN (4326, 3857))[1], cs[1]) AS epsg FROM f"""))  # fmt: skip
def q_epsg_parse(spark, sf_dir):
    text = codes(spark, sf_dir).join(cloud.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return text.select("p_partkey", crs.epsg_in(F.expr(WKT.format(s="string"))).alias("epsg"))


FIRST_POINTS = {
    "x": "case when c_custkey % 4 = 0 then (c_custkey % 180) * 1.0 when c_custkey % 4 = 1 then -1900000.0 + (c_custkey % 500) * 1000.0 when c_custkey % 4 = 2 then 100000.0 + (c_custkey % 1000) * 1000.0 else 5000000.0 end",
    "y": "case when c_custkey % 4 = 0 then (c_custkey % 90) * 1.0 when c_custkey % 4 = 1 then 3000000.0 + (c_custkey % 500) * 1000.0 else 2000000.0 + (c_custkey % 2500) * 1000.0 end",
}


@query(o.with_(f"p AS (SELECT c_custkey, ({FIRST_POINTS['x']})::DOUBLE AS x, ({FIRST_POINTS['y']})::DOUBLE AS y FROM customer)",
  "l AS (SELECT *, degrees(x / 6378137) AS lng, degrees(2 * atan(exp(y / 6378137)) - pi() / 2) AS lat FROM p)", final="""SELECT c_custkey,
  CASE WHEN abs(x) <= 180 AND abs(y) <= 90 THEN 4326
    WHEN abs(x) <= 20037508.342789244 AND abs(y) <= 20037508.342789244 AND lng > -18 AND lng < -13 AND lat > 26 AND lat < 30 THEN 3857
    WHEN x BETWEEN 100000 AND 900000 AND y BETWEEN 2500000 AND 4000000 THEN 32628 ELSE 25830 END AS epsg FROM l"""))  # fmt: skip
def q_crs_infer(spark, sf_dir):
    at = [F.expr(FIRST_POINTS[a]).cast("double") for a in "xy"]
    return cloud.table(spark, sf_dir, "customer").select("c_custkey", crs.inferred_epsg(*at).alias("epsg"))


# Trees


@query(o.with_(o.POINTS, """b AS (SELECT file_index, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM points GROUP BY 1)""",
  final="""SELECT file_index, CASE WHEN ax = bx THEN ax - 0.01 ELSE ax END AS min_x, CASE WHEN ax = bx THEN bx + 0.01 ELSE bx END AS max_x, CASE WHEN ay = by_ THEN ay - 0.01 ELSE ay END AS min_y,
  CASE WHEN ay = by_ THEN by_ + 0.01 ELSE by_ END AS max_y, CASE WHEN az = bz THEN az - 0.01 ELSE az END AS min_z, CASE WHEN az = bz THEN bz + 0.01 ELSE bz END AS max_z FROM b"""))  # fmt: skip
def q_root_bounds(spark, sf_dir):
    """The box of each file's points, which stands for a header's."""
    limits = [f(c).alias(f"_{e}_{a}") for a, c in (("x", "mx"), ("y", "my"), ("z", "z")) for e, f in (("lo", F.min), ("hi", F.max))]
    b = cloud.points(spark, sf_dir).groupBy("file_index").agg(*limits)
    flat = {a: F.when(F.col(f"_lo_{a}") == F.col(f"_hi_{a}"), 0.01).otherwise(0.0) for a in "xyz"}
    return b.select("file_index", *(c for a in "xyz" for c in ((F.col(f"_lo_{a}") - flat[a]).alias(f"min_{a}"), (F.col(f"_hi_{a}") + flat[a]).alias(f"max_{a}"))))


DIAGONALS = "cast(p_size as double) * 97.5 + p_retailprice"


@query(o.with_(f"t AS (SELECT p_partkey, p_size::DOUBLE * 97.5::DOUBLE + p_retailprice AS dg FROM part)",
  final="SELECT p_partkey, coalesce((SELECT min(k) FROM range(0, 8) r(k) WHERE dg / pow(2, k) <= 100), 8)::INT AS depth FROM t"))
def q_max_depth(spark, sf_dir):
    """The depth for many root diagonals: the least level at which a tile is small enough."""
    dg = F.expr(DIAGONALS)
    depth = F.lit(8)
    for k in range(7, -1, -1):
        depth = F.when(dg / 2**k <= cloud.CONFIG.min_diagonal, k).otherwise(depth)
    return cloud.table(spark, sf_dir, "part").select("p_partkey", depth.cast("int").alias("depth"))


@query(o.with_(o.POINTS, o.digits(False), final="SELECT point_index, id6 AS tile_id FROM lv6"))
def q_quadtree_assign(spark, sf_dir):
    return tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH).select("point_index", "tile_id")


@query(o.with_(o.POINTS, o.digits(True), final="SELECT point_index, id6 AS tile_id FROM lv6"))
def q_octree_assign(spark, sf_dir):
    return tiling.leaf_points(cloud.points(spark, sf_dir), cloud.SOLID, cloud.DEPTH).select("point_index", "tile_id")


PYRAMID = "SELECT id, parent_id, file_index, depth, n AS full_count, min_z, max_z, first_point, classes FROM grouped"


def _pyramid(spark, sf_dir, bounds):
    out = tiling.pyramid(cloud.points(spark, sf_dir), bounds, cloud.DEPTH)
    return out.select("id", "parent_id", "file_index", "depth", "full_count", "min_z", "max_z", "first_point", joined("classes").alias("classes"))


@query(o.with_(o.POINTS, o.tiles(False), final=PYRAMID, recursive=True))
def q_quadtree_pyramid(spark, sf_dir):
    return _pyramid(spark, sf_dir, cloud.FLAT)


@query(o.with_(o.POINTS, o.tiles(True), final=PYRAMID, recursive=True))
def q_octree_pyramid(spark, sf_dir):
    return _pyramid(spark, sf_dir, cloud.SOLID)


@query(o.with_(o.POINTS, o.tiles(True), final="SELECT id, lo_x AS min_x, hi_x AS max_x, lo_y AS min_y, hi_y AS max_y, lo_z AS min_z, hi_z AS max_z FROM tiles", recursive=True))
def q_tile_bounds(spark, sf_dir):
    tiles = tiling.pyramid(cloud.points(spark, sf_dir), cloud.SOLID, cloud.DEPTH)
    return tiling.with_bounds(tiles, cloud.SOLID, cloud.DEPTH).select("id", "bounds.*")


@query(o.with_(o.POINTS, o.tiles(False), o.COUNTED.format("tiles"), final=f"""SELECT id, parent_id, child_ids, file_index, '{cloud.LABEL}' AS crs_label, depth, n AS original_point_count, full_n AS full_point_count,
  greatest(n, full_n, sampled) AS source_point_count, greatest(sampled, full_n) AS point_count, sampled AS sampled_point_count, min_z, max_z FROM counted""", recursive=True))  # fmt: skip
def q_tile_records(spark, sf_dir):
    return quad(spark, sf_dir).select(
        "id", "parent_id", joined("child_ids").alias("child_ids"), "file_index", "crs_label", "depth", "original_point_count", "full_point_count", "source_point_count", "point_count", "sampled_point_count", "min_z", "max_z"
    )


@query(o.with_(o.POINTS, o.tiles(False), o.corners(), final="SELECT id, k AS corner, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ring", recursive=True))
def q_tile_corners(spark, sf_dir):
    at = quad(spark, sf_dir).select("id", F.posexplode("corners").alias("corner", "c"))
    return at.select("id", "corner", r6(F.col("c")[0]).alias("lng"), r6(F.col("c")[1]).alias("lat"))


@query(o.with_(o.POINTS, o.tiles(False), final=f"SELECT id, round({o.hypot('hi_x - lo_x', 'hi_y - lo_y', 'max_z - min_z')}, 6) AS diagonal FROM tiles", recursive=True))
def q_tile_diagonal(spark, sf_dir):
    return quad(spark, sf_dir).select("id", r6(cam.diagonal(F.col("bounds"), F.col("min_z"), F.col("max_z"))).alias("diagonal"))


@query(o.with_(o.POINTS, o.tiles(True), final="SELECT id, min_z AS low, max_z AS high, classes FROM tiles", recursive=True))
def q_attribute_index(spark, sf_dir):
    a = octo(spark, sf_dir).select("id", "attribute_indexes.*")
    return a.select("id", F.col("altitude.min").alias("low"), F.col("altitude.max").alias("high"), joined("classification_bins").alias("classes"))


@query(o.with_(o.POINTS, o.digits(False), final="SELECT id6 AS tile_id, 'full' AS kind, point_index, z, classification FROM lv6"))
def q_leaf_full_points(spark, sf_dir):
    out = tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH)
    return out.select("tile_id", F.lit("full").alias("kind"), "point_index", "z", "classification")


@query(o.with_(o.POINTS, o.digits(False), f"parted AS (SELECT id6 AS tile_id, ((row_number() OVER (PARTITION BY id6 ORDER BY point_index) - 1) // {payload.PART_POINTS})::INT AS part, point_index, classification FROM lv6)",
  final="SELECT tile_id, part, count(*) AS n, string_agg(point_index::VARCHAR || ':' || classification::VARCHAR, ',' ORDER BY point_index) AS packed FROM parted GROUP BY 1, 2"))
def q_pack_points(spark, sf_dir):
    """A leaf's points side by side in arrays, a part of the leaf in each."""
    leaves = payload.parted(tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH), ["tile_id"], "point_index")
    packed = leaves.groupBy("tile_id", "part").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("point_index", "mx", "my", "z", "classification"))).alias("p"))
    return packed.select("tile_id", "part", "n", F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["point_index"].cast("string"), p["classification"].cast("string"))), ",").alias("packed"))


@query(o.with_(o.POINTS, o.tiles(False), final="SELECT id, file_index, n FROM tiles WHERE parent_id IS NULL", recursive=True))
def q_root_tiles(spark, sf_dir):
    return quad(spark, sf_dir).where("parent_id IS NULL").orderBy("file_index").select("id", "file_index", F.col("original_point_count").alias("n"))


@query(o.with_(o.POINTS, o.tiles(False), final="SELECT id, CASE WHEN parent_id IS NULL THEN 'root' WHEN n_children > 0 THEN 'intermediate' ELSE 'leaf' END AS type FROM tiles", recursive=True))
def q_tile_type(spark, sf_dir):
    return quad(spark, sf_dir).select("id", labels.tile_type(F.col("parent_id"), F.size("child_ids")).alias("type"))


# Samples


@query(o.with_(o.POINTS, o.digits(False), """ranked AS (SELECT id6 AS tile_id, point_index, row_number() OVER (PARTITION BY id6 ORDER BY md5('7:' || point_index::VARCHAR), point_index) AS rn FROM lv6)""",
  final="SELECT tile_id, point_index FROM ranked WHERE rn <= 5"))
def q_reservoir_sample(spark, sf_dir):
    leaves = tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH)
    order = F.struct(F.md5(F.concat(F.lit("7:"), F.col("point_index").cast("string")).cast("binary")), "point_index")
    return sampling.reservoir(leaves, ["tile_id"], 5, order).select("tile_id", "point_index")


CELL = "greatest(0, least(31, floor(({a} - {lo}::DOUBLE) / {span}::DOUBLE * 32)))"
ROOT_CELLS = ", ".join(f"{CELL.format(a=a, lo=lo, span=hi - lo)}::INT AS cell_{a}" for a, lo, hi in (("x", 456000.0, 460000.0), ("y", 3110000.0, 3114000.0), ("z", 0.0, 300.0)))


@query(o.with_(o.POINTS, final=f"SELECT point_index, {ROOT_CELLS} FROM points"))
def q_m3no_cells(spark, sf_dir):
    rows = tiling.with_bounds(cloud.points(spark, sf_dir), cloud.SOLID, 0)
    return sampling.grid(rows, cloud.CONFIG.grid_cells).select("point_index", "cell_x", "cell_y", "cell_z")


@query(o.with_(o.POINTS, o.grid_levels(0, 32), final="SELECT tile_id, point_index FROM kept"))
def q_m3no_root_sample(spark, sf_dir):
    return sampling.grid_samples(sampling.grid_levels(cloud.points(spark, sf_dir), cloud.SOLID, 0, cloud.CONFIG.grid_cells)).select("tile_id", "point_index")


@query(o.with_(o.POINTS, o.grid_levels(GRID_DEPTH, GRID_CELLS), final="SELECT tile_id, depth, point_index FROM kept"))
def q_m3no_sample(spark, sf_dir):
    """Few cells, so that points are displaced through all levels; the octree's own depth and cells are in q_m3no_full_sample."""
    down = settled(spark, sf_dir, GRID_DEPTH, GRID_CELLS)
    return sampling.settled_samples(down, cloud.SOLID, GRID_DEPTH).select("tile_id", "depth", "point_index")


@query(o.with_(o.POINTS, o.grid_levels(GRID_DEPTH, GRID_CELLS), "k AS (SELECT tile_id, count(*) AS n FROM kept GROUP BY 1)",
  final="SELECT c.tile_id AS id, c.n AS arrived, coalesce(k.n, 0) AS sampled FROM came c LEFT JOIN k USING (tile_id)"))
def q_m3no_counts(spark, sf_dir):
    return sampling.settled_counts(settled(spark, sf_dir, GRID_DEPTH, GRID_CELLS), cloud.SOLID, GRID_DEPTH)


@query(o.with_(o.POINTS, "h AS (SELECT classification, count(*) AS n FROM points GROUP BY 1)",
  "steps AS (SELECT classification, j, row_number() OVER (ORDER BY j / sqrt(n), classification) AS place FROM h, range(1, 1000) r(j) WHERE j < n)",
  final="SELECT classification, 1 + (SELECT count(*) FROM steps s WHERE s.classification = h.classification AND place <= 1000 - (SELECT count(*) FROM h)) AS n FROM h"))
def q_class_budget(spark, sf_dir):
    order = F.md5(F.col("point_index").cast("string").cast("binary"))
    return sampling.by_class(cloud.points(spark, sf_dir), 1000, order).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


# Cameras


@query(o.with_(o.EVENT_CAMERAS, f"a AS (SELECT *, {o.ALTITUDE} AS alt FROM cams)",
  final="SELECT camera_id, round(40075016.68557849::DOUBLE * greatest(cos(radians(lat)), 0.01) / (512 * pow(2::DOUBLE, zoom)), 6) AS mpp, round(alt, 4) AS altitude FROM a"))
def q_camera_altitude(spark, sf_dir):
    c = F.col
    alt = cam.altitude(c("lat"), c("zoom"), c("pitch"), c("viewport_height"), c("fov_degrees"))
    return cloud.camera_events(spark, sf_dir).select("camera_id", r6(cam.metres_per_pixel(c("lat"), c("zoom"))).alias("mpp"), F.round(alt, 4).alias("altitude"))


@query(o.with_(o.EVENT_CAMERAS, "optics AS (SELECT *, 600 + camera_id % 500 AS high, 20.0::DOUBLE + camera_id % 60 AS fov FROM cams)",
  f"a AS (SELECT camera_id, {o.ALTITUDE.replace(' * 900 /', ' * high /').replace(o.FOV, 'radians(fov)')} AS alt FROM optics)", final="SELECT camera_id, round(alt, 4) AS altitude FROM a"))
def q_camera_optics(spark, sf_dir):
    """Views of many heights and angles."""
    c = F.col
    rows = cloud.camera_events(spark, sf_dir).withColumns({"high": F.expr("600 + camera_id % 500"), "fov": F.expr("20.0D + camera_id % 60")})
    return rows.select("camera_id", F.round(cam.altitude(c("lat"), c("zoom"), c("pitch"), c("high"), c("fov")), 4).alias("altitude"))


@query(o.with_(o.EVENT_CAMERAS, o.cameras_at(), final="SELECT camera_id, round(px, 3) AS x, round(py, 3) AS y, round(alt, 3) AS z FROM eye"))
def q_camera_position(spark, sf_dir):
    c = F.col
    alt = cam.altitude(c("lat"), c("zoom"), c("pitch"), c("viewport_height"), c("fov_degrees"))
    rows = cloud.camera_events(spark, sf_dir).withColumn("m", pr.lnglat_to_utm(c("lng"), c("lat"), 28)).withColumn("alt", alt)
    rows = rows.select("camera_id", cam.ground_position(c("m.x"), c("m.y"), c("alt"), c("pitch"), c("bearing")).alias("p"))
    return rows.select("camera_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("p.z", 3).alias("z"))


def _seen(spark, sf_dir, tiles=quad):
    return selection.seen_by(tiles(spark, sf_dir), cloud.cameras(spark, sf_dir))


SEEN = (o.POINTS, o.tiles(False), o.TYPE_CAMERAS, o.seen(False))
SEEN_SOLID = (o.POINTS, o.tiles(True), o.TYPE_CAMERAS, o.seen(True))


@query(o.with_(*SEEN, final="SELECT camera_id, id, round(distance, 3) AS distance FROM seen", recursive=True))
def q_tile_distance(spark, sf_dir):
    return _seen(spark, sf_dir).select("camera_id", "id", F.round("distance", 3).alias("distance"))


@query(o.with_(*SEEN, final="SELECT camera_id, id, round(angle, 4) AS angle FROM seen", recursive=True))
def q_angular_size(spark, sf_dir):
    return _seen(spark, sf_dir).select("camera_id", "id", F.round("angle", 4).alias("angle"))


@query(o.with_(*SEEN, final="SELECT camera_id, id, behind FROM seen", recursive=True))
def q_behind_camera(spark, sf_dir):
    return _seen(spark, sf_dir).select("camera_id", "id", "behind")


@query(o.with_(*SEEN, final="SELECT camera_id, id FROM seen WHERE NOT behind", recursive=True))
def q_visible_tiles(spark, sf_dir):
    return _seen(spark, sf_dir).where("NOT behind").select("camera_id", "id")


# Selection


def _picked(spark, sf_dir, accumulate=False, previous=None):
    tiles = (octo if accumulate else quad)(spark, sf_dir)
    return selection.descend(selection.by_level(tiles), cloud.cameras(spark, sf_dir), cloud.LOD, accumulate, stored, previous)


WALK = """walked AS (
  SELECT id, lpad(file_index::VARCHAR, 10, '0') AS way FROM tiles WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, w.way || '.' || lpad((list_position(string_split(p.child_ids, ','), t.id) - 1)::VARCHAR, 2, '0') FROM walked w JOIN tiles p ON p.id = w.id JOIN tiles t ON t.parent_id = p.id
)"""


@query(o.with_(*SEEN, o.selected(False), WALK, final="""SELECT camera_id, id, depth, n AS points, expanded, active,
  CASE WHEN active THEN (row_number() OVER (PARTITION BY camera_id, active ORDER BY way))::INT END AS rank FROM picked JOIN walked USING (id) WHERE active OR expanded""", recursive=True))  # fmt: skip
def q_lod_quadtree(spark, sf_dir):
    """rank: the order in which a depth-first walk finds the active tiles."""
    picked = stored(_picked(spark, sf_dir).where("active OR expanded"), "picked")
    out = picked.join(selection.ranked(picked).select("camera_id", "id", "rank"), ["camera_id", "id"], "left")
    return out.select("camera_id", "id", "depth", F.col("original_point_count").alias("points"), "expanded", "active", "rank")


#: Expressions of all cameras of events, and the frontier of their descent by recursion.
ALL_SEEN = f"""roots_ AS (SELECT * FROM tiles WHERE parent_id IS NULL),
walk AS (
  SELECT e.camera_id, e.pitch, e.ux, e.uy, e.alt, e.px, e.py, t.*, {{seen}} FROM eye e CROSS JOIN roots_ t
  UNION ALL
  SELECT w.camera_id, w.pitch, w.ux, w.uy, w.alt, w.px, w.py, t.*, {{below}} FROM walk w JOIN tiles t ON t.parent_id = w.id WHERE NOT w.behind AND w.angle >= 15
)"""


def _frontier() -> str:
    dots = ", ".join(f"({x} - px) * (ux - px) + ({y} - py) * (uy - py)" for x in ("t.lo_x", "t.hi_x") for y in ("t.lo_y", "t.hi_y"))
    distance = o.hypot(o.hypot("greatest(t.lo_x - px, px - t.hi_x, 0)", "greatest(t.lo_y - py, py - t.hi_y, 0)"), "greatest(t.min_z - alt, alt - t.max_z, 0)")
    diagonal = o.hypot("t.hi_x - t.lo_x", "t.hi_y - t.lo_y", "t.max_z - t.min_z")
    angle = f"CASE WHEN NOT {diagonal} > 0 THEN 0 WHEN {distance} = 0 THEN 'Infinity'::DOUBLE ELSE degrees(2 * atan({diagonal} / (2 * {distance}))) END"
    seen = f"pitch > 1 AND (ux <> px OR uy <> py) AND greatest({dots}) <= 0 AS behind, {angle} AS angle"
    return ALL_SEEN.format(seen=seen, below=seen)


@query(o.with_(o.POINTS, o.tiles(False), o.EVENT_CAMERAS, o.cameras_at(), _frontier(),
  "kids_ AS (SELECT camera_id, parent_id AS id, bool_or(NOT behind) AS kid FROM walk WHERE parent_id IS NOT NULL GROUP BY ALL)",
  final="""SELECT camera_id, count(*) FILTER (WHERE NOT behind AND (k.id IS NULL OR NOT kid)) AS active, coalesce(sum(n) FILTER (WHERE NOT behind AND (k.id IS NULL OR NOT kid)), 0)::BIGINT AS points,
  count(*) AS reached, count(k.id) AS expanded FROM walk LEFT JOIN kids_ k USING (camera_id, id) GROUP BY 1""", recursive=True))  # fmt: skip
def q_lod_all_cameras(spark, sf_dir):
    """A camera for each event, all at once: what each reaches, opens and shows."""
    return selection.figures(quad(spark, sf_dir), cloud.camera_events(spark, sf_dir), cloud.LOD, False, stored)


@query(o.with_(*SEEN_SOLID, o.selected(True), final="SELECT camera_id, id, depth, n AS points, expanded, active FROM picked WHERE active OR expanded", recursive=True))
def q_lod_m3no(spark, sf_dir):
    out = _picked(spark, sf_dir, True).where("active OR expanded")
    return out.select("camera_id", "id", "depth", F.col("full_point_count").alias("points"), "expanded", "active")


@query(o.with_(*SEEN, "memory AS (SELECT s.*, depth % 2 = 0 AS was FROM seen s)", o.selected(False, "memory", "was"), final="SELECT camera_id, id FROM picked WHERE active", recursive=True))
def q_lod_hysteresis(spark, sf_dir):
    """As if every tile of an even depth had been open before."""
    tiles, cameras = quad(spark, sf_dir), cloud.cameras(spark, sf_dir)
    before = tiles.where("depth % 2 = 0").select("id").join(selection.sent_if_few(cameras.select("camera_id")))
    return selection.descend(selection.by_level(tiles), cameras, cloud.LOD, False, stored, before).where("active").select("camera_id", "id")


@query(o.with_(o.POINTS, o.tiles(False), o.described("tiles"), final="SELECT id, source, render_count, render_key FROM drawn", recursive=True))
def q_render_descriptor(spark, sf_dir):
    return selection.descriptors(quad(spark, sf_dir)).select("id", "source", "render_count", "render_key")


def _resident(described: DataFrame) -> DataFrame:
    """Half of the tiles, a third of these under an old key."""
    own = described.where(F.expr("min_first % 2 = 0"))
    return own.select("id", F.when(F.expr("min_first % 3 = 0"), F.concat("id", F.lit(":sample:0"))).otherwise(F.col("render_key")).alias("render_key"))


def _described(spark, sf_dir):
    points = cloud.points(spark, sf_dir)
    first = tiling.pyramid(points, cloud.FLAT, cloud.DEPTH).select("id", F.col("first_point").alias("min_first"))
    return selection.descriptors(quad(spark, sf_dir)).join(first, "id")


DRAWN = (o.POINTS, o.tiles(False), o.described("tiles"), """resident AS (SELECT id, CASE WHEN first_point % 3 = 0 THEN id || ':sample:0' ELSE render_key END AS render_key FROM drawn WHERE first_point % 2 = 0)""")


@query(o.with_(*DRAWN, final="SELECT id, render_key FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM resident r WHERE r.id = d.id AND r.render_key = d.render_key)", recursive=True))
def q_fetch_list(spark, sf_dir):
    described = _described(spark, sf_dir)
    return selection.fetch_list(described, _resident(described)).select("id", "render_key")


@query(o.with_(*DRAWN, final="SELECT id FROM drawn WHERE id NOT IN (SELECT id FROM resident)", recursive=True))
def q_missing_tiles(spark, sf_dir):
    described = _described(spark, sf_dir)
    return selection.missing(described, _resident(described)).select("id")


@query(o.with_(*DRAWN, final="""SELECT coalesce(d.id, r.id) AS id, CASE WHEN d.id IS NULL THEN 'delete' WHEN r.id IS NULL THEN 'create' WHEN d.render_key = r.render_key THEN 'keep' ELSE 'replace' END AS action
  FROM (SELECT * FROM drawn WHERE depth <> 3) d FULL JOIN resident r ON d.id = r.id""", recursive=True))  # fmt: skip
def q_residency_diff(spark, sf_dir):
    """Tiles of depth 3 are no longer wanted."""
    described = _described(spark, sf_dir)
    return selection.residency(described.where("depth <> 3"), _resident(described)).select("id", "action")


@query(o.with_(*SEEN, o.selected(False), o.described("picked"), final="SELECT camera_id, count(*) AS tiles, sum(render_count)::BIGINT AS rendered, sum(greatest(n, full_n, sampled))::BIGINT AS available FROM drawn WHERE active GROUP BY 1", recursive=True))
def q_active_totals(spark, sf_dir):
    return selection.active_totals(selection.descriptors(_picked(spark, sf_dir).where("active")), ["camera_id"])


@query(o.with_(o.POINTS, o.tiles(False), """climb AS (
  SELECT id AS start, parent_id AS up FROM tiles WHERE n_children = 0 AND first_point % 5 = 0
  UNION ALL
  SELECT c.start, t.parent_id FROM climb c JOIN tiles t ON t.id = c.up WHERE NOT (t.depth <= 3 AND t.n_children > 0 AND t.first_point % 2 = 0) AND t.parent_id IS NOT NULL
)""", final="SELECT DISTINCT t.id FROM climb c JOIN tiles t ON t.id = c.up WHERE t.depth <= 3 AND t.n_children > 0 AND t.first_point % 2 = 0", recursive=True))  # fmt: skip
def q_pending_parents(spark, sf_dir):
    """Pending: some leaves; open: some tiles above depth 4."""
    tiles = _described(spark, sf_dir)
    pending = tiles.where("size(child_ids) = 0 AND min_first % 5 = 0")
    return selection.pending_parents(pending, tiles, tiles.where("depth <= 3 AND size(child_ids) > 0 AND min_first % 2 = 0"))


# Store


@query(o.with_(o.POINTS, o.tiles(False), "v AS (SELECT id, n, 0 AS batch FROM tiles UNION ALL SELECT id, n + 1, 1 FROM tiles WHERE depth >= 3 UNION ALL SELECT id, n + 2, 2 FROM tiles WHERE depth >= 5)",
  final="SELECT id, arg_max(n, batch) AS n, max(batch)::INT AS batch FROM v GROUP BY 1", recursive=True))
def q_upsert_latest(spark, sf_dir):
    tiles = quad(spark, sf_dir).select("id", "depth", F.col("original_point_count").alias("n"))
    more = [tiles.where(f"depth >= {d}").select("id", (F.col("n") + b).alias("n"), F.lit(b).alias("batch")) for b, d in ((0, 0), (1, 3), (2, 5))]
    return latest(more[0].union(more[1]).union(more[2]))


# Figures and reports


def _files(spark, sf_dir):
    sums = cloud.points(spark, sf_dir).groupBy("file_index").agg(F.count(F.lit(1)).alias("n"))
    return sums.select(
        F.concat(F.lit("f"), F.col("file_index").cast("string")).alias("name"), F.col("n").alias("source_point_count"), F.col("n").alias("valid_point_count"), F.lit(120.0).alias("read_ms"),
        F.lit(2500.0).alias("index_ms"), F.lit(800.0).alias("save_ms"), F.lit("utm").alias("crs_kind"), F.lit(32628).alias("crs_code"), F.lit(cloud.LABEL).alias("crs_label"),
    )


STATS = """totals AS (SELECT count(*) AS tile_count, max(n) AS max_points, avg(n) AS avg_points, max(sampled) AS max_sampled, max(CASE WHEN n_children = 0 THEN full_n END) AS max_full FROM counted),
ps AS (SELECT count(*) AS n, count(DISTINCT file_index) AS files FROM points)"""


@query(o.with_(o.POINTS, o.tiles(False), o.COUNTED.format("tiles"), STATS, final=f"""SELECT files AS file_count, n AS source_point_count, n AS valid_point_count, tile_count, max_points AS max_points_per_node,
  round(avg_points, 6) AS average_points_per_node, max_sampled AS max_sampled_points_per_node, max_full AS max_full_points_per_leaf, 'utm' AS crs_kinds, 'EPSG:32628' AS crs_codes, '{cloud.LABEL}' AS crs_summary,
  round(n / (files * 2.5), 4) AS points_per_second FROM totals, ps""", recursive=True))  # fmt: skip
def q_cloud_stats(spark, sf_dir):
    out = stats.cloud_stats(quad(spark, sf_dir), _files(spark, sf_dir))
    return out.select("file_count", "source_point_count", "valid_point_count", "tile_count", "max_points_per_node", r6(F.col("average_points_per_node")).alias("average_points_per_node"), "max_sampled_points_per_node", "max_full_points_per_leaf", "crs_kinds", "crs_codes", "crs_summary", F.round("points_per_second", 4).alias("points_per_second"))


@query(o.with_(o.POINTS, o.tiles(False), o.corners(), final="SELECT round(min(lng), 5) AS min_lng, round(max(lng), 5) AS max_lng, round(min(lat), 5) AS min_lat, round(max(lat), 5) AS max_lat FROM ring", recursive=True))
def q_cloud_bounds(spark, sf_dir):
    out = stats.lnglat_bounds(quad(spark, sf_dir))
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@query(o.with_(o.POINTS, o.inverse("points", "ll"), final="SELECT round((min(lng) + max(lng)) / 2, 6) AS lng, round((min(lat) + max(lat)) / 2, 6) AS lat FROM ll"))
def q_point_center(spark, sf_dir):
    rows = pr.with_lnglat(cloud.points(spark, sf_dir), F.col("mx"), F.col("my"), 28)
    return stats.point_center(rows).select(r6(F.col("lng")).alias("lng"), r6(F.col("lat")).alias("lat"))


@query(o.with_(o.POINTS, o.digits(False), """s AS (SELECT id2 AS tile_id, z, row_number() OVER (PARTITION BY id2 ORDER BY point_index) AS rn, greatest(ceil(count(*) OVER (PARTITION BY id2) / 2000.0), 1) AS step FROM lv6)""",
  final="SELECT tile_id, count(*) AS n, round(greatest(max(z * 1.5::DOUBLE + 2), 0), 4) AS max_altitude FROM s WHERE rn % step = 0 GROUP BY 1"))
def q_max_altitude(spark, sf_dir):
    """The highest drawn point of each tile of depth 2 over every n-th of its points."""
    rows = tiling.with_digits(cloud.points(spark, sf_dir), cloud.FLAT, 2).withColumn("tile_id", tiling.tile_id(cloud.FLAT, ["d1", "d2"]))
    few = sampling.stride(rows, ["tile_id"], "point_index")
    high = F.greatest(F.max(F.col("z") * 1.5 + 2.0), F.lit(0.0))
    return few.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.round(high, 4).alias("max_altitude"))


@query(o.with_(o.POINTS, final="SELECT count(*) AS valid_point_count FROM points"))
def q_progressive_stats(spark, sf_dir):
    return stats.progressive_valid(quad(spark, sf_dir))


def _g(x: str) -> str:
    return f"regexp_replace(reverse(regexp_replace(reverse(({x})::VARCHAR), '([0-9]{{3}})', '\\1,', 'g')), '^,', '')"


@query(o.with_(o.POINTS, o.tiles(False), o.COUNTED.format("tiles"), STATS, final=f"""SELECT unnest(['Files', 'Nodes', 'LAS points', 'Max / node', 'Avg / node', 'Max sampled / node', 'Max full / leaf', 'CRS', 'Total', 'Read', 'Angular threshold', 'Hysteresis',
    'Type', 'Active nodes', 'Min node diagonal', 'Max tree depth', 'Valid projected', 'Rendered now', 'Visible source', 'Kinds', 'EPSG', 'Index', 'Store', 'Rate']) AS label,
  unnest([files::VARCHAR, {_g('tile_count')}, {_g('n')}, {_g('max_points')}, {_g('floor(avg_points * 10 + 0.5)::BIGINT // 10')} || '.' || (floor(avg_points * 10 + 0.5)::BIGINT % 10)::VARCHAR, {_g('max_sampled')}, {_g('max_full')},
    '{cloud.LABEL}', {o.dec('files * 3420.0 / 1000', 2)} || ' s', (files * 120)::VARCHAR || ' ms', '15.00 deg', '10%',
    'QuadTree', '12', '100 m', '8', {_g('n')}, '3,456', '7,890', 'utm', 'EPSG:32628', {o.dec('files * 2500.0 / 1000', 2)} || ' s', {o.dec('files * 800.0 / 1000', 2)} || ' s',
    {_g('floor(n / (files * 2.5::DOUBLE) * 100 + 0.5)::BIGINT // 100')} || '.' || lpad((floor(n / (files * 2.5::DOUBLE) * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || ' pts/s']) AS value FROM totals, ps""", recursive=True))  # fmt: skip
def q_stats_report(spark, sf_dir):
    figures = stats.cloud_stats(quad(spark, sf_dir), _files(spark, sf_dir))
    return stats.report(figures, F.lit("QuadTree"), F.lit(12), F.lit(3456), F.lit(7890), cloud.CONFIG, cloud.LOD).select("label", "value")


@query(o.with_(o.POINTS, o.tiles(False), o.corners(), f"b AS (SELECT min(lng) AS a, max(lng) AS z, min(lat) AS s, max(lat) AS n FROM ring)",
  f"w AS (SELECT greatest(max(max_z), 0) AS top, greatest(max({o.hypot('hi_x - lo_x', 'hi_y - lo_y', 'max_z - min_z')}), 1000) AS wide FROM tiles)",
  "c AS (SELECT (a + z) / 2 AS lng, (s + n) / 2 AS lat, top + greatest(1000, wide * 0.7::DOUBLE) AS altitude FROM b, w)",
  final=f"""SELECT round(lng, 5) AS lng, round(lat, 5) AS lat, round(altitude, 4) AS altitude, 65.0::DOUBLE AS pitch,
  round(least(greatest(log2(40075016.68557849::DOUBLE * cos(radians(lat)) / (512 * (2 * altitude * tan({o.FOV} / 2) / cos(radians(65)) / 900))), 8), 18), 6) AS zoom FROM c""", recursive=True))  # fmt: skip
def q_fly_to(spark, sf_dir):
    out = stats.fly_to(quad(spark, sf_dir))
    return out.select(F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"), F.round("altitude", 4).alias("altitude"), "pitch", r6(F.col("zoom")).alias("zoom"))


# Labels, shapes, colours

METRES = f"CASE WHEN distance < 1000 THEN {o.dec('distance', 0)} || ' m' WHEN distance < 10000 THEN {o.dec('distance / 1000', 1)} || ' km' ELSE {o.dec('distance / 1000', 0)} || ' km' END"
RATIO = f"CASE WHEN distance <= 0 THEN 'inf' WHEN diagonal / distance < 10 THEN {o.dec('diagonal / distance', 2)} || 'x' ELSE {o.dec('diagonal / distance', 1)} || 'x' END"
TYPE = "CASE WHEN parent_id IS NULL THEN 'root' WHEN n_children > 0 THEN 'intermediate' ELSE 'leaf' END"


def _label() -> Column:
    c = F.col
    return labels.detail(c("parent_id"), F.size("child_ids"), c("depth"), c("distance"), c("diagonal"))


@query(o.with_(*SEEN, final=f"SELECT camera_id, id, {TYPE} || ' LOD ' || depth || ' - ' || {METRES} || ' - diag/dist ' || {RATIO} AS label FROM seen", recursive=True))
def q_tile_labels(spark, sf_dir):
    return _seen(spark, sf_dir).select("camera_id", "id", _label().alias("label"))


@query(o.with_(o.POINTS, o.tiles(False), o.corners(), o.COUNTED.format("tiles"), "closed AS (SELECT id, k, lng, lat FROM ring UNION ALL SELECT id, 4, lng, lat FROM ring WHERE k = 0)",
  final=f"SELECT id, greatest(sampled, full_n) AS points, {TYPE} AS label, k::INT AS corner, round(lng, 5) AS lng, round(lat, 5) AS lat FROM counted JOIN closed USING (id)", recursive=True))
def q_tile_geojson(spark, sf_dir):
    """The GeoJSON of each tile, read back: points, label and the corners of its closed ring."""
    kind = "type string, properties struct<id: string, pointCount: bigint, detailLabel: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    label = labels.tile_type(F.col("parent_id"), F.size("child_ids"))
    made = geometry.outlines(quad(spark, sf_dir), label).select(F.from_json("feature", kind).alias("f")).where("f.type = 'Feature' AND f.geometry.type = 'Polygon'")
    made = made.select("f.properties.*", F.posexplode(F.col("f.geometry.coordinates")[0]).alias("corner", "c"))
    return made.select("id", F.col("pointCount").alias("points"), F.col("detailLabel").alias("label"), "corner", F.round(F.col("c")[0], 5).alias("lng"), F.round(F.col("c")[1], 5).alias("lat"))


CLASS_ROWS = ", ".join(f"({k}, '{n}', {c[0]}, {c[1]}, {c[2]})" for k, n, c in labels.CLASSES)


@query(o.with_(o.RAW, f"dim(code, label, r, g, b) AS (VALUES {CLASS_ROWS})", final="""SELECT classification, coalesce(label, 'Other') AS label, count(*) AS n, coalesce(r, 0.94)::DOUBLE AS red, coalesce(g, 0.05)::DOUBLE AS green, coalesce(b, 0.14)::DOUBLE AS blue
  FROM raw LEFT JOIN dim ON classification = code GROUP BY ALL"""))  # fmt: skip
def q_class_colors(spark, sf_dir):
    counts = cloud.raw_points(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    return geometry.coloured(counts, geometry.class_table(spark)).select("classification", "label", "n", "red", "green", "blue")


HSL = "h AS (SELECT p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS h, (p_size % 10) / 10.0::DOUBLE AS s, (p_partkey % 7) / 7.0::DOUBLE AS l FROM part)"
HSL2 = "c AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c, h * 6 AS k FROM h), x AS (SELECT *, c * (1 - abs(k - 2 * floor(k / 2) - 1)) AS x, l - c / 2 AS m FROM c)"


def _channel(order: str) -> str:
    return "CASE " + " ".join(f"WHEN k < {i + 1} THEN {v}" for i, v in enumerate(order)) + " END"


@query(o.with_(HSL, HSL2, final=f"SELECT p_partkey, round(m + {_channel('cx00xc')}, 6) AS red, round(m + {_channel('xccx00')}, 6) AS green, round(m + {_channel('00xccx')}, 6) AS blue FROM x"))
def q_hsl_to_rgb(spark, sf_dir):
    hsl = [F.expr(e) for e in ("(p_partkey % 100) / 100.0D", "(p_size % 10) / 10.0D", "(p_partkey % 7) / 7.0D")]
    rows = cloud.table(spark, sf_dir, "part").select("p_partkey", labels.hsl_to_rgb(*hsl).alias("c"))
    return rows.select("p_partkey", *(r6(F.col(f"c.{k}")).alias(k) for k in ("red", "green", "blue")))


@query(o.with_(o.POINTS, o.digits(False), o.inverse("lv6", "ll"),
  "m AS (SELECT id6 AS tile_id, point_index, (lng + 180) / 360 AS ux, 0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) AS uy, lng, lat, z FROM ll)",
  "an AS (SELECT tile_id, (min(lng) + max(lng)) / 2 AS al, (min(lat) + max(lat)) / 2 AS anchor_lat, (min(z) + max(z)) / 2 AS az FROM m GROUP BY 1)",
  final="SELECT point_index, tile_id, round((ux - (al + 180) / 360) * 1e6, 2) + 0.0::DOUBLE AS rel_x, round((uy - (0.5 - ln(tan(pi() / 4 + radians(anchor_lat) / 2)) / (2 * pi()))) * 1e6, 2) + 0.0::DOUBLE AS rel_y, round(az, 4) AS anchor FROM m JOIN an USING (tile_id)"))
def q_render_positions(spark, sf_dir):
    """In millionths of the map's side, two decimals: about 0.4 m."""
    rows = pr.with_lnglat(tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH), F.col("mx"), F.col("my"), 28)
    out = geometry.render_positions(rows.select("point_index", "tile_id", "lng", "lat", "z"))
    return out.select("point_index", "tile_id", (F.round(F.col("rel_x").cast("double") * 1e6, 2) + F.lit(0.0)).alias("rel_x"), (F.round(F.col("rel_y").cast("double") * 1e6, 2) + F.lit(0.0)).alias("rel_y"), F.round("anchor_height", 4).alias("anchor"))


@query(o.with_(o.POINTS, o.tiles(False), o.corners(),
  "e(edge, a, b) AS (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0), (4, 4, 5), (5, 5, 6), (6, 6, 7), (7, 7, 4), (8, 0, 4), (9, 1, 5), (10, 2, 6), (11, 3, 7))",
  final="""SELECT t.id, edge, round(p.lng, 6) AS a_lng, round(p.lat, 6) AS a_lat, CASE WHEN a < 4 THEN min_z ELSE max_z END AS a_height, round(q.lng, 6) AS b_lng, round(q.lat, 6) AS b_lat, CASE WHEN b < 4 THEN min_z ELSE max_z END AS b_height
  FROM tiles t CROSS JOIN e JOIN ring p ON p.id = t.id AND p.k = a % 4 JOIN ring q ON q.id = t.id AND q.k = b % 4""", recursive=True))  # fmt: skip
def q_box_edges(spark, sf_dir):
    out = geometry.boxes(quad(spark, sf_dir))
    return out.select("id", "edge", *(r6(F.col(c)).alias(c) if c.endswith(("lng", "lat")) else F.col(c) for c in out.columns if c not in ("id", "edge")))


# Streams of events and points


@query(o.with_("g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)",
  "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)",
  final="SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM s GROUP BY user_id, burst"))
def q_camera_debounce(spark, sf_dir):
    return debounced(cloud.table(spark, sf_dir, "events"), "user_id", "ts", "1 hour", "event_id")


SNAPSHOT = 10_000


@query(o.with_(o.POINTS, "n AS (SELECT *, row_number() OVER (PARTITION BY file_index ORDER BY point_index) - 1 AS arrival FROM points)", o.digits(False, 2, "n"),
  f"f AS (SELECT file_index, arrival // {SNAPSHOT} AS step, unnest([id0, id1, id2]) AS id FROM lv2)", "l AS (SELECT file_index, max(step) AS last FROM f GROUP BY 1)",
  "a AS (SELECT file_index, step, id, count(*) AS added FROM f GROUP BY ALL)",
  final="SELECT id, step, (sum(added) OVER (PARTITION BY id ORDER BY step ROWS UNBOUNDED PRECEDING))::BIGINT AS count, step = last AS is_final FROM a JOIN l USING (file_index)"))
def q_progressive_snapshots(spark, sf_dir):
    points = cloud.points(spark, sf_dir)
    # A file's points number themselves as they are read; here the number is the rank of the index within buckets of orders.
    numbered = _arrivals(points)
    return snapshots(numbered, cloud.FLAT, 2, SNAPSHOT).select("id", "step", "count", "is_final")


def _arrivals(points: DataFrame) -> DataFrame:
    """The rank of each point in its file from 0."""
    return sampling.places(points, ["file_index"], "point_index", 1_000_000, "arrival").drop("group_size")


@query(o.with_(o.POINTS, o.tiles(False), final="SELECT id, n AS full_count FROM tiles", recursive=True))
def q_progressive_tiles(spark, sf_dir):
    """What a stream of all points ends with."""
    return progressive_tiles(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH).select("id", "full_count")
