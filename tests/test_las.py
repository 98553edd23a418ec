"""LAS files of all kinds, written here, read by the data source and loaded into a store."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.config import Bounds, IndexConfig, LodConfig, clamped
from stratapoint.operators import load
from stratapoint.sources import las
from stratapoint.sources.scratch import stored
from stratapoint.sources.tiles import TileStore

UTM = 'PROJCS["x",AUTHORITY["EPSG","32628"],UNIT["metre",1]]'


def vlr(record, data, user=b"LASF_Projection"):
    return struct.pack("<H16sHH32s", 0, user, record, len(data), "é description".encode()) + data


def geo_keys(**keys):
    entries = [(3072 if k == "projected" else 2048, 0, 1, v) for k, v in keys.items()]
    return struct.pack("<4H", 1, 1, 0, len(entries)) + b"".join(struct.pack("<4H", *e) for e in entries)


def write(path, points, kind=0, version=(1, 2), vlrs=(), scale=0.01, offset=(456000.0, 3110000.0, 0.0), bits=0, cut=0, magic=b"LASF", count=None, limits=None):
    """points: raw x, y, z, class byte."""
    size = {0: 20, 3: 34, 6: 30}[kind]
    at = 16 if kind >= 6 else 15
    head_size = 375 if version >= (1, 4) else 227
    body = b"".join(vlrs)
    head = bytearray(head_size)
    head[:4], head[24:26] = magic, bytes(version)
    n = len(points) if count is None else count
    struct.pack_into("<HII", head, 94, head_size, head_size + len(body), len(vlrs))
    struct.pack_into("<BHI", head, 104, kind | bits, size, 0 if kind >= 6 else n)
    raw = np.array([p[:3] for p in points] or [(0, 0, 0)], float) * scale + offset
    lo, hi = (raw.min(axis=0), raw.max(axis=0)) if limits is None else limits
    struct.pack_into("<12d", head, 131, *(scale,) * 3, *offset, *(v for a in range(3) for v in (hi[a], lo[a])))
    if version >= (1, 4):
        struct.pack_into("<Q", head, 247, n)
    records = b""
    for x, y, z, k in points:
        r = bytearray(size)
        struct.pack_into("<3i", r, 0, x, y, z)
        r[at] = k
        records += r
    data = bytes(head) + body + records
    path.write_bytes(data[: len(data) - cut] if cut else data)
    return str(path)


def some(n, seed=1, top=400_000):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), int(c), int(k)) for a, b, c, k in zip(rng.integers(0, top, n), rng.integers(0, top, n), rng.integers(0, 30_000, n), rng.integers(0, 256, n))]


def test_points_of_all_formats(spark, tmp_path):
    files = [
        (write(tmp_path / "a.las", some(700, 1), 0, vlrs=[vlr(2112, UTM.encode())]), some(700, 1), 0x1F),
        (write(tmp_path / "b.LAS", some(300, 2), 3, vlrs=[vlr(34735, geo_keys(projected=25828))]), some(300, 2), 0x1F),
        (write(tmp_path / "c.las", some(200, 3), 6, (1, 4)), some(200, 3), 0xFF),
    ]
    (tmp_path / "notes.txt").write_text("no points")
    paths = [f for f, _, _ in files]
    rows = las.read_las(spark, [str(tmp_path / "notes.txt"), *paths], points_per_partition="128").orderBy("file_index", "point_index").collect()
    want = [(i, j, k & mask) for i, (_, points, mask) in enumerate(files) for j, (_, _, _, k) in enumerate(points)]
    assert [(r.file_index, r.point_index, r.classification) for r in rows] == want
    raw = [p for _, points, _ in files for p in points]
    assert all(abs(r.x - (p[0] * 0.01 + 456000)) < 1e-9 and abs(r.y - (p[1] * 0.01 + 3110000)) < 1e-9 and r.z == p[2] * 0.01 for r, p in zip(rows, raw))
    heads = {r.file_index: r for r in las.headers(spark, paths).collect()}
    assert [(heads[i].version, heads[i].point_format, heads[i].record_length, heads[i].point_count) for i in range(3)] == [("1.2", 0, 20, 700), ("1.2", 3, 34, 300), ("1.4", 6, 30, 200)]
    assert [heads[i].crs_label for i in range(3)] == ["EPSG:32628 UTM zona 28N (WKT)", "EPSG:25828 UTM zona 28N (GeoTIFF VLR)", "EPSG:32628 UTM zona 28N (inferred UTM 28N for the Canary Islands)"]
    assert las.class_histogram(las.read_las(spark, paths[:1])).agg(F.sum("count")).first()[0] == 700


def test_coordinate_systems_in_order_of_trust(tmp_path):
    points = some(3)
    found = lambda *vlrs, **how: las.inspect(write(tmp_path / "x.las", points, vlrs=vlrs, **how))[2]["code"]
    assert found(vlr(2112, UTM.encode()), vlr(34735, geo_keys(projected=25830))) == 32628
    assert found(vlr(34735, geo_keys(geographic=4326))) == 4326
    assert found(vlr(34735, geo_keys(projected=32733, geographic=4326))) == 32733
    assert found(vlr(2112, UTM.encode(), user=b"other")) == 32628  # guessed: the record is not a projection's
    assert found(scale=1e-7, offset=(-15.4, 28.1, 0.0)) == 4326
    assert found(offset=(-1_700_000.0, 3_270_000.0, 0.0)) == 3857
    assert found(offset=(456_000.0, 4_400_000.0, 0.0)) == 25830
    with pytest.raises(ValueError, match="neither geographic"):
        found(vlr(2112, b'AUTHORITY["EPSG","2154"]'))


def test_broken_files(spark, tmp_path):
    points = some(10)
    for how, message in ((dict(magic=b"LAZF"), "signature"), (dict(bits=0x80), "compressed"), (dict(count=0), "no points")):
        with pytest.raises(ValueError, match=message):
            las.inspect(write(tmp_path / "bad.las", points, **how))
    with pytest.raises(ValueError, match="no points"):
        las.inspect(write(tmp_path / "empty.las", []))
    cut = write(tmp_path / "cut.las", points, cut=25)  # within the ninth record
    assert las.read_las(spark, [cut]).count() == 8


@pytest.mark.parametrize("mode", ["quadtree", "m3no"])
def test_a_load_from_end_to_end(spark, tmp_path, mode):
    paths = [write(tmp_path / "a.las", some(900, 5), vlrs=[vlr(2112, UTM.encode())]), write(tmp_path / "b.las", some(400, 6, 90_000), 6, (1, 4))]
    store = TileStore(spark, str(tmp_path / mode))
    said, seen = [], []
    config = IndexConfig(tile_sample_points=50, grid_cells=4, min_diagonal=1000, max_depth=3)
    figures = load.load_files(spark, paths, store, mode, config, stored, lambda h: seen.append(h["path"]), lambda *x: said.append(x)).orderBy("file_index").collect()
    assert [(f.source_point_count, f.valid_point_count) for f in figures] == [(900, 900), (400, 400)]
    assert seen == paths and [x[:2] for x in said] == [(0, "indexed"), (0, "saved"), (1, "indexed"), (1, "saved")]
    tiles = {r.id: r for r in store.all_tiles().collect()}
    root = "r" if mode == "quadtree" else "m3no"
    assert {t.id for t in tiles.values() if t.parent_id is None} == {f"0:{root}", f"1:{root}"}
    assert tiles[f"0:{root}"].full_point_count == (900 if mode == "m3no" else 0) and tiles[f"1:{root}"].original_point_count == 400
    leaves = [t for t in tiles.values() if not t.child_ids]
    assert sum(t.full_point_count for t in leaves) == 1300
    for t in leaves[:3]:
        got = store.get(t.id, "full").collect()
        assert len(got) == t.full_point_count and all(t.bounds.min_x <= p.mx <= t.bounds.max_x and t.bounds.min_y <= p.my <= t.bounds.max_y for p in got)
    many = store.get_many(spark.createDataFrame([(leaves[0].id, "full"), ("7:r.1", "full")], "id string, source string"))
    assert many.count() == leaves[0].full_point_count
    sampled = {r.tile_id: r["count"] for r in store.points().where("kind = 'sample'").groupBy("tile_id").count().collect()}
    assert all(sampled.get(t.id, 0) == t.sampled_point_count for t in tiles.values())
    if mode == "quadtree":
        assert max(sampled.values()) == 50
    store.upsert(spark.createDataFrame([(f"0:{root}", 0, 0, 5)], "id string, file_index int, depth int, original_point_count long").select("id", "file_index", "depth", "original_point_count"), 1)
    assert store.all_tiles().count() == len(tiles)
    store.clear()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.all_tiles()


def test_a_file_of_invalid_points_ends_the_load(spark, tmp_path):
    path = write(tmp_path / "far.las", some(20), vlrs=[vlr(34735, geo_keys(geographic=4326))])  # metres taken for degrees
    with pytest.raises(ValueError, match="no valid points"):
        load.load_files(spark, [path], TileStore(spark, str(tmp_path / "s")), "quadtree", IndexConfig(), stored)


def test_settings_are_checked():
    assert clamped("7.5", 1) == 7.5 and clamped("x", 3) == 3 and clamped(float("inf"), 3) == 3 and clamped(None, 2) == 2
    assert clamped(99, 1, 0, 10) == 10 and clamped("-4", 1, 0) == 0
    assert IndexConfig(max_depth=0.2).max_depth == 1 and IndexConfig(max_depth=2.5).max_depth == 3
    for wrong in (dict(min_diagonal=0), dict(max_depth=17), dict(tile_sample_points=0)):
        with pytest.raises(ValueError):
            IndexConfig(**wrong)
    for wrong in (dict(threshold_degrees=0), dict(threshold_degrees=91), dict(hysteresis=0.6)):
        with pytest.raises(ValueError):
            LodConfig(**wrong)
    box = Bounds(5, 1, 2, 1)
    assert (box.min_x, box.max_x, box.min_y, box.max_y) == (2, 5, 0.99, 1.01)
