"""The store's snapshots: lost and overtaken writers, replays, compaction; loads of unlike and of bad files; trees that grow; skipped files."""

import pytest
from pyspark.sql import functions as F

from stratapoint.config import Bounds, IndexConfig
from stratapoint.operators import load, sampling, tiling
from stratapoint.plans import files
from stratapoint.sources.tiles import COMPACT_AFTER, Conflict, TileStore

POINTS = "file_index int, point_index long, mx double, my double, z double, classification int"


def tiles_of(spark, rows):
    return spark.createDataFrame(rows, "id string, file_index int, depth int, n long")


def points_of(spark, rows):
    return spark.createDataFrame(rows, "tile_id string, file_index int, kind string, depth int, point_index long")


@pytest.fixture
def store(spark, tmp_path):
    store = TileStore(spark, str(tmp_path / "store"))
    store.save(tiles_of(spark, [("0:r", 0, 0, 3), ("0:r.1", 0, 1, 2)]), points_of(spark, [("0:r", 0, "sample", 0, 1), ("0:r.1", 0, "full", 1, 2)]))
    return store


def held(store):
    return sorted((r.id, r.n) for r in store.all_tiles().collect())


def test_a_writer_lost_between_tiles_and_points_leaves_the_former_snapshot(spark, store):
    before = store.snapshot()
    bad = points_of(spark, [("0:r", 0, "sample", 0, 9)]).withColumn("point_index", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.save(tiles_of(spark, [("0:r", 0, 0, 99)]), bad)
    store._write(tiles_of(spark, [("0:r", 0, 0, 98)]), None, 1)  # written, never committed
    assert store.snapshot() == before and held(store) == [("0:r", 3), ("0:r.1", 2)]
    fs, path = store._fs(f"manifests/{before[0] + 1:010d}.json")
    stream = fs.create(path, False)  # a manifest that ends in its first line
    stream.write(bytearray(b'{"writes": [{"na'))
    stream.close()
    assert store.snapshot() == before
    store.upsert(tiles_of(spark, [("0:r", 0, 0, 4)]), 1)
    assert held(store) == [("0:r", 4), ("0:r.1", 2)]


def test_an_overtaken_writer_is_refused(spark, store):
    base, writes = store.snapshot()
    store.upsert(tiles_of(spark, [("0:r", 0, 0, 4)]), 1)
    with pytest.raises(Conflict):
        store._commit(base, writes)
    assert held(store) == [("0:r", 4), ("0:r.1", 2)]


def test_old_snapshots_stay_until_vacuum(spark, store):
    first, _ = store.snapshot()
    store.upsert(tiles_of(spark, [("0:r.2", 0, 1, 1)]), 1)
    store.clear()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.all_tiles()
    assert held(store.at(first)) == [("0:r", 3), ("0:r.1", 2)] and held(store.at(first + 1))[-1] == ("0:r.2", 1)
    with pytest.raises(ValueError):
        store.at(first).upsert(tiles_of(spark, [("0:r.2", 0, 1, 1)]), 1)
    store.save(tiles_of(spark, [("1:r", 1, 0, 5)]), points_of(spark, [("1:r", 1, "sample", 0, 1)]))
    store.vacuum()
    assert len(store.versions()) == 1 and held(store) == [("1:r", 5)]
    fs, path = store._fs("data")
    assert len(fs.listStatus(path)) == 1


def test_a_hundred_upserts_leave_one_version_of_each_tile(spark, store):
    for batch in range(1, 101):
        store.upsert(tiles_of(spark, [("0:r", 0, 0, batch), (f"0:r.{batch % 4}", 0, 1, batch)]), batch)
        assert sum(w.tiles for w in store.snapshot()[1]) <= COMPACT_AFTER
    store.compact()
    own = [w for w in store.snapshot()[1] if w.tiles]
    assert len(own) == 1
    raw = spark.read.parquet(f"{store.path}/data/{own[0].name}/tiles")
    assert raw.count() == raw.select("id").distinct().count() == 5
    assert held(store) == [("0:r", 100), ("0:r.0", 100), ("0:r.1", 97), ("0:r.2", 98), ("0:r.3", 99)]
    assert [r.point_index for r in store.get("0:r").collect()] == [1]  # points are as they were


def test_a_batch_written_again_counts_once(spark, store):
    for _ in range(3):
        store.upsert(tiles_of(spark, [("0:r", 0, 0, 7)]), 5)
    assert sum(w.batch == 5 for w in store.snapshot()[1]) == 1 and held(store)[0] == ("0:r", 7)


def test_samples_are_replaced_and_full_points_added(spark, store):
    store.grow(tiles_of(spark, [("0:r", 0, 0, 5)]), points_of(spark, [("0:r", 0, "sample", 0, 8), ("0:r.1", 0, "full", 1, 9)]), 1)
    assert [r.point_index for r in store.get("0:r").collect()] == [8]
    assert sorted(r.point_index for r in store.get("0:r.1", "full").collect()) == [2, 9]
    store.upsert(tiles_of(spark, [("0:r", 0, 0, 6)]), 2)  # metadata alone leave the sample
    assert [r.point_index for r in store.get("0:r").collect()] == [8]
    wanted = spark.createDataFrame([("0:r", "sample"), ("0:r.1", "full"), ("7:r", "full")], "id string, source string")
    assert sorted(r.point_index for r in store.get_many(wanted).collect()) == [2, 8, 9]


def las(spark, tmp_path, name, n, epsg=32628, cut=None):
    import numpy as np

    rng = np.random.default_rng(n)
    x, y, z = (rng.integers(0, w, n) for w in (40_000, 20_000, 5_000))
    data = files.las_bytes(x, y, z, rng.integers(0, 9, n).astype("u1"), system=files.wkt(epsg))
    path = tmp_path / name
    path.write_bytes(data[:cut] if cut else data)
    return str(path)


@pytest.mark.parametrize("mode", ["quadtree", "m3no"])
def test_a_bad_file_leaves_the_store_as_it_was(spark, store, tmp_path, mode):
    keep = lambda df, tag: spark.createDataFrame(df.collect(), df.schema)
    before = store.snapshot()
    good = las(spark, tmp_path, "a.las", 300)
    for bad, what in ((las(spark, tmp_path, "b.las", 50, cut=100), "header is cut off"), (las(spark, tmp_path, "c.las", 50, epsg=4326), "no valid points in .*c.las")):
        with pytest.raises(Exception, match=what):
            load.load_files(spark, [good, bad], store, mode, IndexConfig(), keep)
        assert store.snapshot() == before
    told, heads = [], []
    figures = load.load_files(spark, [good, las(spark, tmp_path, "d.las", 200, epsg=25830), "x.txt"], store, mode, IndexConfig(), keep, heads.append, on_points=lambda *x: told.append(x))
    assert [(r.name, r.valid_point_count, r.crs_code) for r in figures.orderBy("file_index").collect()] == [("a.las", 300, 32628), ("d.las", 200, 25830)]
    roots = store.tiles(0).collect()
    assert {r.file_index: r.full_point_count + (r.original_point_count if mode != "m3no" else 0) for r in roots} == {0: 300, 1: 200}
    assert [h["path"][-5:] for h in heads] == ["a.las", "d.las"]
    assert told == [("read", 500, 500)]


def test_progress_comes_from_the_running_job(spark, tmp_path):
    import time

    from stratapoint.sources.progress import reported

    told = []
    with reported(spark, "read", 80_000, lambda *x: told.append(x)) as counter:
        def slow(rows):
            for i, _ in enumerate(rows):
                if i % 5000 == 0:
                    time.sleep(0.3)
                counter.add(1)
                yield 1
        assert spark.sparkContext.parallelize(range(80_000), 16).mapPartitions(slow).count() == 80_000
    done = [d for _, d, _ in told]
    assert len(done) > 2 and done == sorted(done) and done[-1] == 80_000 and all(d < 80_000 for d in done[:-1])


def test_a_forest_grows_the_trees_that_single_boxes_grow(spark):
    import random

    rng = random.Random(2)
    boxes = {0: Bounds(0, 0, 500, 400, 0, 50), 2: Bounds(5, 5, 160, 30, 0, 9)}
    rows = [(f, 1000 * f + i, rng.uniform(b.min_x, b.max_x), rng.uniform(b.min_y, b.max_y), rng.uniform(b.min_z, b.max_z), rng.choice([0, 2, 63, 64, 130, 255])) for f, b in boxes.items() for i in range(150)]
    points = spark.createDataFrame(rows, POINTS)
    config = IndexConfig(grid_cells=2, tile_sample_points=9, max_depth=2)
    heads = spark.createDataFrame([(f, *map(float, (b.min_x, b.min_y, b.min_z, b.max_x, b.max_y, b.max_z)), "utm", 32628, 28, True, "label") for f, b in boxes.items()],
        "file_index int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, crs_kind string, crs_code int, crs_zone int, crs_northern boolean, crs_label string")
    keep = lambda df, tag: spark.createDataFrame(df.collect(), df.schema)
    for mode in ("quadtree", "m3no"):
        forest = load.forest_of(heads, mode == "m3no", config, keep)
        index = load.build_index(points, mode, forest, config, None, keep)
        got = [sorted(map(str, df.collect())) for df in (index.tiles, index.samples, index.full, index.preview)]
        want = [[], [], [], []]
        for f, b in boxes.items():
            b = b if mode == "m3no" else Bounds(b.min_x, b.min_y, b.max_x, b.max_y)
            one = load.build_index(points.where(f"file_index = {f}"), mode, b, config, ("utm", 32628, 28, True, "label"), keep)
            for part, df in zip(want, (one.tiles, one.samples, one.full, one.preview)):
                part += map(str, df.collect())
        assert got == [sorted(w) for w in want]


def test_classes_unite_as_sets(spark):
    rows = [(0, i, float(i % 10), float(i // 10), 1.0, c) for i, c in enumerate([0, 1, 63, 64, 127, 128, 191, 192, 255, 255, 7] * 9)] + [(0, 500, 1.0, 1.0, 1.0, None)]
    out = tiling.pyramid(spark.createDataFrame(rows, POINTS), Bounds(0, 0, 10, 10), 2)
    for r in out.collect():
        assert r.classes == sorted(set(r.classes))
    assert out.where("depth = 0").first().classes == [0, 1, 7, 63, 64, 127, 128, 191, 192, 255]


def test_samples_when_the_hash_says_nothing(spark):
    """All hashes alike and high: the bound on them leaves too few, and is moved until it leaves enough."""
    points = spark.createDataFrame([(0, i, float(i % 16), float(i % 7), 0.0, 1) for i in range(400)], POINTS).withColumn("_hash", F.lit("f" * 32))
    out = sampling.bottom_samples(points, Bounds(0, 0, 16, 8), 3, 5, "_hash", lambda df, tag: spark.createDataFrame(df.collect(), df.schema)).collect()
    by = {}
    for r in out:
        by.setdefault((r.depth, r.tile_id), []).append(r.point_index)
    assert sorted(by[0, "0:r"]) == [0, 1, 2, 3, 4] and all(len(v) <= 5 for v in by.values())


@pytest.mark.parametrize("cells, depth", [(2, 3), (4, 2)])
def test_a_tree_that_grows_by_halves_is_that_of_one_load(spark, cells, depth):
    import random

    rng = random.Random(cells)
    bounds = Bounds(0, 0, 64, 64, 0, 64)
    rows = [(0, i, rng.uniform(0, 64), rng.uniform(0, 64), rng.uniform(0, 64), 1) for i in range(600)] + [(0, 600 + i, 1.0, 1.0, 1.0, 2) for i in range(20)]
    points = spark.createDataFrame(rows, POINTS)
    keep = lambda level, df: spark.createDataFrame(df.collect(), df.schema)
    whole = sampling.grid_levels(points, bounds, depth, cells, keep)
    first = sampling.grid_levels(points.where("point_index < 300"), bounds, depth, cells, keep)
    samples = keep(0, sampling.grid_samples(first))
    second = sampling.grid_levels(points.where("point_index >= 300"), bounds, depth, cells, keep, samples)
    merged = load.grown_samples(samples, sampling.grid_samples(second), second)
    assert sorted(map(str, merged.collect())) == sorted(map(str, sampling.grid_samples(whole).collect()))
    counts = load.grown_counts(sampling.grid_counts(first), sampling.grid_counts(second))
    assert sorted(map(str, counts.collect())) == sorted(map(str, sampling.grid_counts(whole).select("id", "arrived", "sampled").collect()))


def test_files_that_a_filter_rules_out_are_not_opened(spark, tmp_path):
    from stratapoint.sources.las import read_las

    paths = [las(spark, tmp_path, f"{k}.las", 100 + k, epsg=e) for k, e in enumerate((32628, 25830, 32629))]
    rows = read_las(spark, paths, skip_files="true")
    keep = rows.where("crs_code = 25830 AND z >= 0.0")
    assert keep.count() == 101 and keep.rdd.getNumPartitions() == 1
    assert rows.where("z > 1000.0").count() == 0
    assert rows.where("x >= 456000.0 AND x <= 456010.0").count() == read_las(spark, paths).where("x >= 456000.0 AND x <= 456010.0").count()
    assert rows.where("file_index IN (0, 2)").count() == 202


def test_large_payloads_are_parts(spark):
    from stratapoint.operators import payload

    rows = [(t, 7 * i + 3, float(i), float(-i), 1.0, i % 5) for t in ("a", "b") for i in range(250 if t == "a" else 3)]
    points = spark.createDataFrame(rows, "tile_id string, point_index long, mx double, my double, z double, classification int").repartition(5)
    parts = payload.packed(points, ["tile_id"], "point_index", size=100)
    assert sorted((r.tile_id, r.part, r.payload.point_count) for r in parts.collect()) == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50), ("b", 0, 3)]
    back = sorted(tuple(r) for r in payload.unpacked(parts, ["tile_id"], size=100).collect())
    assert back == sorted((t, (i - 3) // 7, x, y, z, k) for t, i, x, y, z, k in rows)
