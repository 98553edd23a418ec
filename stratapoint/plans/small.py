"""Queries of the smaller operators: payloads, look-ups, filters, labels, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapoint.functions import labels
from stratapoint.operators import geometry, payload, selection, stats, tiling
from stratapoint.plans import cloud, oracles as o
from stratapoint.plans.queries import DRAWN, _described, _files, _g, _resident, octo, quad, query, r6
from stratapoint.streaming.progress import not_stale, progress_events

# Payloads


def _payloads(spark, sf_dir):
    leaves = tiling.leaf_points(cloud.points(spark, sf_dir), cloud.FLAT, cloud.DEPTH)
    return payload.packed(leaves, ["tile_id"], "point_index")


@query(o.with_(o.POINTS, o.digits(False), final="SELECT id6 AS tile_id, row_number() OVER (PARTITION BY id6 ORDER BY point_index) - 1 AS place, x AS mx, y AS my, z, classification FROM lv6"))
def q_payload_unpack(spark, sf_dir):
    """Packed side by side, and unpacked again as rows."""
    return payload.unpacked(_payloads(spark, sf_dir), ["tile_id"])


@query(o.with_(o.POINTS, o.digits(False), f"p AS (SELECT id6 AS tile_id, (row_number() OVER (PARTITION BY id6 ORDER BY point_index) - 1) // {payload.PART_POINTS} AS part FROM lv6)", "n AS (SELECT tile_id, part, count(*) AS n FROM p GROUP BY ALL)",
  final="SELECT tile_id, sum(CASE WHEN n % 2 = 0 THEN n ELSE 0 END)::BIGINT AS packed, bool_or(n % 2 = 0) AS is_stored, sum(CASE WHEN n % 2 = 0 THEN n ELSE 0 END)::BIGINT AS listed, count(*) FILTER (WHERE n % 2 = 0) AS single FROM n GROUP BY 1"))
def q_point_counts(spark, sf_dir):
    """Counts of payloads, lists and single points; parts of odd counts hold none, and a payload without points is not stored."""
    rows = _payloads(spark, sf_dir).withColumn("p", F.col("payload"))
    even = F.col("p.point_count") % 2 == 0
    some = F.when(even, F.col("p.point_count")).otherwise(0)
    rows = rows.select("tile_id", payload.payload(some, F.col("p.coordinates"), F.col("p.classifications")).alias("kept"), F.when(even, F.col("p.classifications")).alias("list"), F.when(even, F.col("p.coordinates")[0]).alias("one"))
    counts = [F.sum(payload.point_count(F.col(c), rows.schema[c].dataType)).alias(n) for c, n in (("kept", "packed"), ("list", "listed"), ("one", "single"))]
    return rows.groupBy("tile_id").agg(F.bool_or(F.col("kept").isNotNull()).alias("is_stored"), *counts)


# Look-ups and filters


@query(o.with_(o.POINTS, o.tiles(False), final="SELECT id, CASE WHEN file_index = 1 THEN 25830 ELSE 32628 END AS crs_code, CASE WHEN file_index = 1 THEN 30 ELSE 28 END AS crs_zone FROM tiles", recursive=True))
def q_tile_crs(spark, sf_dir):
    """File 1 has a CRS of its own; the tiles of file 0 keep theirs."""
    files = spark.createDataFrame([(1, "utm", 25830, 30, True)], "file_index int, crs_kind string, crs_code int, crs_zone int, crs_northern boolean")
    return selection.with_crs_of_file(quad(spark, sf_dir), files).select("id", "crs_code", "crs_zone")


@query(o.with_(*DRAWN, final="""SELECT d.id, CASE WHEN d.first_point % 5 = 0 THEN 0 ELSE d.render_count END AS points FROM drawn d
  WHERE (d.first_point % 5 <> 0 AND d.render_count > 0) OR EXISTS (SELECT 1 FROM resident r WHERE r.id = d.id AND r.render_key = d.render_key)""", recursive=True))  # fmt: skip
def q_renderable_tiles(spark, sf_dir):
    """A fifth of the tiles came without points; those already resident under their key stay."""
    described = _described(spark, sf_dir)
    fetched = described.where("min_first % 5 <> 0").select("id", F.col("render_count").alias("points"))
    return selection.renderable(described, fetched, _resident(described)).select("id", "points")


@query(o.with_(o.POINTS, o.tiles(False), final="SELECT id, depth FROM tiles WHERE first_point % 5 = 0 AND n_children > 0", recursive=True))
def q_highlighted_tiles(spark, sf_dir):
    tiles = _described(spark, sf_dir)
    return selection.highlighted(tiles, tiles.where("min_first % 5 = 0 AND size(child_ids) > 0").select("id")).select("id", "depth")


@query(o.with_(o.POINTS, o.tiles(True), final="SELECT id, 'full' AS source, n AS render_count FROM tiles WHERE n_children = 0", recursive=True))
def q_octree_descriptor(spark, sf_dir):
    return selection.descriptors(octo(spark, sf_dir)).where("size(child_ids) = 0").select("id", "source", "render_count")


@query("""SELECT c.c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN round(floor(c_acctbal / 100) * 1.5::DOUBLE, 4) ELSE 0 END AS elevation FROM customer c""")
def q_terrain_elevation(spark, sf_dir):
    """Heights of a terrain that covers half of the places."""
    ground = spark.range(50).select(F.col("id").alias("cell_x"), F.lit(0).cast("long").alias("cell_y"), (F.col("id") * 1.5).alias("elevation"))
    places = cloud.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("mx"), F.lit(5.0).alias("my"))
    return geometry.with_terrain(places, ground, 100.0).select("c_custkey", F.round("elevation", 4).alias("elevation"))


MATRIX = [0.5, 0.25, -1.0, 0.125, 2.0, -0.5, 0.75, 1.5, -0.25, 1.0, 0.5, 2.0, 10.0, -20.0, 30.0, 1.0]
TIMES = ", ".join(f"({' + '.join(f'{MATRIX[4 * c + r]}::DOUBLE * {v}' for c, v in enumerate(('p_partkey', 'p_size', 'p_retailprice')))} + {MATRIX[12 + r]}::DOUBLE)::FLOAT::DOUBLE AS m{r}" for r in range(4))


@query(f"SELECT p_partkey, {TIMES} FROM part")
def q_matrix_times_point(spark, sf_dir):
    c = F.col
    out = geometry.transformed(MATRIX, c("p_partkey").cast("double"), c("p_size").cast("double"), c("p_retailprice"))
    return cloud.table(spark, sf_dir, "part").select("p_partkey", *(out[i].cast("double").alias(f"m{i}") for i in range(4)))


@query(o.with_(o.POINTS, o.tiles(False), o.corners(), final="""SELECT t.file_index, round(avg((lng + 180) / 360) * 1e6, 3) AS x, round(avg(0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 1e6, 3) AS y, round(avg((min_z + max_z) / 2), 4) AS height
  FROM tiles t JOIN ring r ON r.id = t.id WHERE t.depth = 2 GROUP BY 1""", recursive=True))  # fmt: skip
def q_box_anchor(spark, sf_dir):
    """The mean place of the boxes of depth 2, by file, in millionths of the map's side."""
    edges = geometry.boxes(quad(spark, sf_dir).where("depth = 2")).withColumn("file_index", F.substring_index("id", ":", 1).cast("int"))
    out = geometry.box_anchor(edges, ["file_index"])
    return out.select("file_index", F.round(F.col("x") * 1e6, 3).alias("x"), F.round(F.col("y") * 1e6, 3).alias("y"), F.round("height", 4).alias("height"))


# Labels and messages


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {o.dec(f'abs({x})', 5)})"


BOX = {"w": "c_acctbal / 100", "s": "(c_custkey % 90) * 0.5 - 20", "e": "c_acctbal / 100 + 1.25", "n": "(c_custkey % 90) * 0.5"}


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE {_signed('w')} || ', ' || {_signed('s')} || ' / ' || {_signed('e')} || ', ' || {_signed('n')} END AS label FROM (SELECT c_custkey, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in BOX.items())} FROM customer)")
def q_bounds_label(spark, sf_dir):
    rows = cloud.table(spark, sf_dir, "customer").select("c_custkey", *(F.when(F.col("c_custkey") % 7 != 0, F.expr(v).cast("double")).alias(k) for k, v in BOX.items()))
    return rows.select("c_custkey", labels.lnglat_bounds(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'M3NO' ELSE 'QuadTree' END AS label FROM part")
def q_mode_label(spark, sf_dir):
    rows = cloud.table(spark, sf_dir, "part").select("p_partkey", F.expr("element_at(array('quadtree', 'other', 'm3no'), cast(3 - p_partkey % 3 as int))").alias("mode"))
    return rows.select("p_partkey", labels.indexing_mode(F.col("mode")).alias("label"))


@query(o.with_(o.POINTS, o.tiles(False), o.COUNTED.format("tiles"), final=f"""SELECT 'QuadTree - ' || count(DISTINCT file_index) || ' files - ' || {_g('count(*) FILTER (WHERE depth = 2)')} || ' active / ' || {_g('count(*)')} || ' tiles - ' ||
  {_g('sum(sampled) FILTER (WHERE depth = 2)')} || ' sampled points rendered from ' || {_g('sum(n) FILTER (WHERE depth = 0)')} || ' source points - {cloud.LABEL}' AS status FROM counted""", recursive=True))  # fmt: skip
def q_status_line(spark, sf_dir):
    """As if the tiles of depth 2 were active."""
    two = F.col("depth") == 2
    sums = quad(spark, sf_dir).agg(
        F.count_distinct("file_index").alias("files"), F.count_if(two).alias("active"), F.count(F.lit(1)).alias("tiles"),
        F.sum(F.when(two, F.col("sampled_point_count"))).alias("rendered"), F.sum(F.when(F.col("depth") == 0, F.col("original_point_count"))).alias("available"),
    )
    names = ("files", "active", "tiles", "rendered", "available")
    return sums.select(stats.status_line(labels.indexing_mode(F.lit("quadtree")), *(F.col(n) for n in names), F.lit(cloud.LABEL)).alias("status"))


LEGEND = ", ".join(f"({i}, '{k}', '{n}', {c[0]}, {c[1]}, {c[2]}, {c[3]})" for i, (k, n, c) in enumerate([*labels.CLASSES, ("Other", "Other classifications", labels.OTHER_CLASS[1])]))


CODES = ", ".join(str(k) for k, _, _ in labels.CLASSES)


@query(o.with_(o.RAW, f"n AS (SELECT CASE WHEN classification IN ({CODES}) THEN classification::VARCHAR ELSE 'Other' END AS code, count(*) AS points FROM raw GROUP BY 1)",
  final=f"SELECT position, code, label, round(r * 255::DOUBLE, 6) AS red, round(g * 255::DOUBLE, 6) AS green, round(b * 255::DOUBLE, 6) AS blue, alpha::DOUBLE AS alpha, coalesce(points, 0)::BIGINT AS points FROM (VALUES {LEGEND}) v(position, code, label, r, g, b, alpha) LEFT JOIN n USING (code)"))
def q_legend(spark, sf_dir):
    """The legend of the cloud: every class with its colour and its points, those of no class under the fallback."""
    out = geometry.legend_of(cloud.raw_points(spark, sf_dir))
    return out.select("position", "code", "label", *(r6(F.col(c)).alias(c) for c in ("red", "green", "blue")), "alpha", "points")


@query(o.with_(o.RAW, "f AS (SELECT file_index, count(*) AS n FROM raw GROUP BY 1)", final="""SELECT file_index, p AS processed, p = n AS is_final FROM f, range(1, 1000000) r(k), LATERAL (SELECT k * 5000 AS p) WHERE p < n
  UNION ALL SELECT file_index, n, true FROM f"""))  # fmt: skip
def q_progress_events(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.substring("name", 2, 9).cast("int").alias("file_index"), F.col("valid_point_count").alias("n"))
    return progress_events(files).select("file_index", "processed", "is_final")


@query("""SELECT event_id, user_id FROM (SELECT *, (event_id * 7919) % 1000 AS refresh, max((event_id * 7919) % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events)
  WHERE newest IS NULL OR refresh >= newest""")  # fmt: skip
def q_stale_results(spark, sf_dir):
    """Answers in order of arrival; the number of the request is made from the event."""
    answers = cloud.table(spark, sf_dir, "events").withColumn("refresh", F.expr("(event_id * 7919) % 1000"))
    return not_stale(answers, "user_id", "refresh", ["ts", "event_id"]).select("event_id", "user_id")


#: A control's limits, for values as they come: numbers, text, nothing.
LIMITS = (1.0, 90.0, 15.0)
GIVEN = "CASE event_id % 6 WHEN 0 THEN cast(user_id - 40 AS {s}) WHEN 1 THEN 'wide' WHEN 2 THEN NULL WHEN 3 THEN cast(event_id % 100 AS {s}) || '.25' WHEN 4 THEN '1e999' ELSE '' END"


@query(f"""SELECT event_id, CASE WHEN v IS NULL OR isinf(v) OR isnan(v) THEN {LIMITS[2]}::DOUBLE ELSE greatest({LIMITS[0]}::DOUBLE, least({LIMITS[1]}::DOUBLE, v)) END AS threshold
  FROM (SELECT event_id, try_cast({GIVEN.format(s='VARCHAR')} AS DOUBLE) AS v FROM events)""")  # fmt: skip
def q_clamped_settings(spark, sf_dir):
    """A threshold from what each event gives."""
    low, high, fallback = LIMITS
    given = F.expr(GIVEN.format(s="string"))
    return cloud.table(spark, sf_dir, "events").select("event_id", labels.clamped_value(given, fallback, low, high).alias("threshold"))
