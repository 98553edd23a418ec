"""Streams that start again from their checkpoint go on where they stopped, and end as a batch does; refreshes from a store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratapoint.config import Bounds, IndexConfig, LodConfig
from stratapoint.operators import load, selection
from stratapoint.sources.tiles import TileStore
from stratapoint.streaming.progress import not_stale
from stratapoint.streaming.state import due_snapshots, fresh_results, growing_samples

POINTS = "file_index int, point_index long, mx double, my double, z double, classification int"


def fed(spark, tmp_path, parts, schema, make, mode):
    """The rows of a stream that is stopped and started again after each part, batch by batch."""
    out = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.append(df.collect())).trigger(availableNow=True).start()
        run.awaitTermination()
    return out


def test_late_results_are_dropped_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, rng.randrange(9), t) for t in range(60) for s in ("a", "b")]
    schema = "session string, refresh long, t long"
    got = fed(spark, tmp_path, [rows[:40], rows[40:80], rows[80:]], schema, lambda df: fresh_results(df, "session", "refresh", ["t"]), "append")
    want = not_stale(spark.createDataFrame(rows, schema), "session", "refresh", ["t"]).collect()
    assert sorted(map(tuple, (r for part in got for r in part))) == sorted(map(tuple, want))


def test_samples_of_a_stream_are_those_of_a_load(spark, tmp_path):
    rng, bounds = random.Random(2), Bounds(0, 0, 16, 16)
    rows = [(0, i, rng.uniform(0, 16), rng.uniform(0, 16), rng.uniform(-5, 5), 1) for i in range(300)]
    got = fed(spark, tmp_path, [rows[:120], rows[120:130], rows[130:]], POINTS, lambda df: growing_samples(df, bounds, 2, 7), "update")
    last = {}
    for part in got:
        last |= {r.tile_id: r for r in part}
    assert last["0:r"].full_count == 300 and last["0:r"].min_z == min(r[4] for r in rows)
    keep = lambda df, tag: spark.createDataFrame(df.collect(), df.schema)
    want = {}
    for r in load.tile_samples(spark.createDataFrame(rows, POINTS), bounds, 2, 7, keep).collect():
        want.setdefault(r.tile_id, set()).add(r.point_index)
    assert {k: set(r.sample) for k, r in last.items()} == want


def test_snapshots_wait_for_points_and_time(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    steps = [(0, 60_000), (100, 60_000), (299, 10), (301, 10), (400, 99_000), (500, 2_000), (650, 0), (700, 5)]
    rows = [(0, start + dt.timedelta(milliseconds=ms), n, i == len(steps) - 1) for i, (ms, n) in enumerate(steps)]
    got = fed(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]], "file_index int, ts timestamp, points long, is_last boolean", due_snapshots, "append")
    told = sorted((r.points, r.is_final) for part in got for r in part)
    assert told == [(120_020, False), (221_020, False), (221_025, True)]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    from stratapoint.sources.scratch import stored

    rng, bounds = random.Random(3), Bounds(456000.0, 3110000.0, 456800.0, 3110800.0)
    points = spark.createDataFrame([(0, i, rng.uniform(456000, 456800), rng.uniform(3110000, 3110800), rng.uniform(0, 50), 1) for i in range(2000)], POINTS)
    store = TileStore(spark, str(tmp_path_factory.mktemp("store")))
    index = load.build_index(points, "quadtree", bounds, IndexConfig(tile_sample_points=50), ("utm", 32628, 28, True, "label"), stored)
    store.save(index.tiles, index.samples.withColumn("kind", F.lit("sample")).unionByName(index.full.withColumn("kind", F.lit("full"))))
    return store


CAMERA = "camera_id string, lng double, lat double, zoom double, pitch double, bearing double, viewport_height int, fov_degrees double"


def test_a_refresh_draws_what_a_selection_finds(spark, loaded):
    from stratapoint.sources.scratch import stored

    cameras = spark.createDataFrame([("near", -15.444, 28.113, 17.0, 30.0, 10.0, 900, 36.87), ("far", -15.44, 28.11, 11.0, 0.0, 0.0, 900, 36.87)], CAMERA)
    closed = selection.select_for_cameras(loaded.tiles(), cameras, LodConfig(), False)
    want = {(r.camera_id, r.id) for r in closed.where("active").collect()}
    out = selection.refresh(loaded, cameras, LodConfig(), False, stored)
    drawn = {(r.camera_id, r.id): r for r in out["drawn"].collect()}
    assert drawn.keys() == want and {r.action for r in out["actions"].collect()} == {"create"}
    assert out["missing"].isEmpty() and out["pending"].isEmpty()
    assert {(r.camera_id, r.id) for r in out["open"].collect()} == {(r.camera_id, r.id) for r in closed.where("expanded").collect()}
    again = selection.refresh(loaded, cameras, LodConfig(), False, stored, out["drawn"], out["open"])
    assert {r.action for r in again["actions"].collect()} == {"keep"}
    away = selection.refresh(loaded, cameras.where("camera_id = 'far'"), LodConfig(), False, stored, out["drawn"], out["open"])
    assert {(r.camera_id, r.action) for r in away["actions"].collect()} == {("far", "keep"), ("near", "delete")}
    told = []
    selection.descend(loaded.tiles, cameras, LodConfig(), False, stored, on_level=lambda *x: told.append(x))
    tiles = {d: loaded.tiles(d).count() for d in range(1, 5)}
    assert told and all(read <= tiles[d] for d, _, read in told)


def test_missing_tiles_are_asked_for_once_more(spark, loaded):
    from stratapoint.sources.scratch import stored

    cameras = spark.createDataFrame([("near", -15.444, 28.113, 17.0, 30.0, 10.0, 900, 36.87)], CAMERA)
    pauses, asked = [], []

    def fetch(store, wanted, known=None):
        asked.append({r.id for r in wanted.collect()})
        lost = sorted(asked[0])[: 2 if len(asked) == 1 else 1]
        got = selection.fetched(store, wanted, known)
        return got.where(~F.col("id").isin(lost))

    out = selection.refresh(loaded, cameras, LodConfig(), False, stored, again=lambda: pauses.append(1), fetch=fetch)
    first = sorted(asked[0])
    assert pauses == [1] and asked[1] == set(first[:2]) and len(asked) == 2
    assert [r.id for r in out["missing"].collect()] == first[:1]
    assert {r.id for r in out["drawn"].collect()} == set(first[1:])
    assert [r.id for r in out["pending"].collect()] == [first[0].rpartition(".")[0]]
