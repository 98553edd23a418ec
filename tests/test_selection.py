"""Selections over ids that are no paths, the selector's memory, streams that fail, budgets by class."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratapoint.config import Bounds, LodConfig
from stratapoint.functions import camera as cam
from stratapoint.operators.sampling import class_budgets, places, stride
from stratapoint.operators.selection import select_tiles
from stratapoint.streaming.progress import Selector, start_progressive

BOX = "struct<min_x: double, min_y: double, max_x: double, max_y: double>"
TILES = [
    ("root", None, ["front-child", "behind-child"], (-100.0, -100.0, 100.0, 100.0)),
    ("front-child", "root", [], (-20.0, 20.0, 20.0, 80.0)),
    ("behind-child", "root", ["behind-grandchild"], (-20.0, -80.0, 20.0, -20.0)),
    ("behind-grandchild", "behind-child", [], (-20.0, -80.0, 20.0, -50.0)),
]


def behind(bounds="bounds"):
    """For a camera at the origin that looks north."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return cam.behind(F.col(bounds), zero, zero, zero, one)


def test_what_lies_wholly_behind_the_camera(spark):
    rows = spark.createDataFrame([("behind", (-10.0, -30.0, 10.0, -5.0)), ("partly", (-10.0, -5.0, 10.0, 5.0))], f"id string, bounds {BOX}")
    assert {r.id: r.b for r in rows.select("id", behind().alias("b")).collect()} == {"behind": True, "partly": False}


def test_tiles_behind_the_camera_are_never_reached(spark):
    tiles = spark.createDataFrame(TILES, f"id string, parent_id string, child_ids array<string>, bounds {BOX}").withColumn("file_index", F.lit(0))
    out = {r.id: r for r in select_tiles(tiles, ~behind(), F.lit(True), False, dotted=False).collect()}
    assert [i for i, r in out.items() if r.active] == ["front-child"]
    assert [i for i, r in out.items() if r.expanded] == ["root"]
    assert not out["behind-grandchild"].reached


def test_the_selector_forgets_on_reset(spark, sf):
    from stratapoint.plans import cloud
    from stratapoint.plans.queries import quad

    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    selector = Selector(quad(spark, sf).where("depth <= 2"), LodConfig(), False, keep)
    cameras = cloud.cameras(spark, sf)
    first = {(r.camera_id, r.id) for r in selector.select(cameras).where("expanded").collect()}
    assert {(r.camera_id, r.id) for r in selector.open.collect()} == first
    again = {(r.camera_id, r.id) for r in selector.select(cameras).where("expanded").collect()}
    assert first <= again  # an open tile needs less to stay open
    selector.reset()
    assert selector.open is None
    assert {(r.camera_id, r.id) for r in selector.select(cameras).where("expanded").collect()} == first


def test_batches_come_in_order_and_an_error_ends_the_stream(spark, tmp_path):
    schema = "file_index int, mx double, my double, z double"
    for i in range(3):
        spark.createDataFrame([(0, float(i), float(j), 1.0) for j in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def keep(tiles, batch):
        seen.extend((batch, r.full_count) for r in tiles.where("depth = 0").collect())

    start_progressive(points, Bounds(0, 0, 8, 8), 2, keep, str(tmp_path / "a"), None).awaitTermination()
    assert seen == [(0, 5), (1, 10), (2, 15)]

    def fail(tiles, batch):
        if batch == 1:
            raise RuntimeError("the store is full")
        tiles.collect()
        seen.append(batch)

    seen.clear()
    with pytest.raises(Exception, match="the store is full"):
        start_progressive(points, Bounds(0, 0, 8, 8), 2, fail, str(tmp_path / "b"), None).awaitTermination()
    assert seen == [0]


def test_bursts_of_a_stream_end_with_their_last_event(spark, tmp_path):
    from stratapoint.streaming.progress import debounced

    schema = "user long, ts timestamp, what string"
    for i, rows in enumerate([[(1, 0, "a"), (1, 50, "b"), (2, 10, "x")], [(1, 100, "c"), (1, 400, "d"), (2, 2000, "y")], [(3, 90_000, "z")]]):
        one = spark.createDataFrame([(u, ms, w) for u, ms, w in rows], "user long, ms long, what string")
        one.select("user", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"), "what").coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "1 second")
    run = debounced(events, "user", "ts", "80 milliseconds", "what").writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user, r.what, r.events) for r in spark.table("bursts").collect()) == [(1, "c", 3), (1, "d", 1), (2, "x", 1), (2, "y", 1)]


def bought_one_by_one(counts, budget):
    """Each class has a point; then always the cheapest next one."""
    paid = dict.fromkeys(counts, 1)
    while sum(paid.values()) < budget:
        k = min((k for k in counts if paid[k] < counts[k]), key=lambda k: (paid[k] / math.sqrt(counts[k]), k))
        paid[k] += 1
    return paid


def test_class_budgets_equal_buying_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        counts = {k: rng.choice([1, 2, 3, rng.randrange(1, 50), rng.randrange(1, 5000)]) for k in rng.sample(range(32), rng.randrange(1, 9))}
        budget = rng.randrange(len(counts), sum(counts.values()) + 3)
        assert class_budgets(counts, budget) == (bought_one_by_one(counts, budget) if budget < sum(counts.values()) else counts)
    assert class_budgets({1: 100, 2: 50, 3: 1}, 2) == {2: 1, 3: 1}
    assert class_budgets({1: 5, 2: 0}, 3) == {1: 3} and class_budgets({}, 9) == {}


def test_places_do_not_depend_on_the_buckets(spark):
    rng = random.Random(1)
    rows = [(g, n) for g in "ab" for n in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, n long")
    want = {(g, n): sum(x < n for h, x in rows if h == g) for g, n in rows}
    for width in (7, 1000, 1_000_000):
        assert {(r.g, r.n): r.place for r in places(df, ["g"], "n", width).collect()} == want
    assert stride(df, ["g"], "n", 100, 50).count() == 200
