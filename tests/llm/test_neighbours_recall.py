"""Recall of the neighbours where groups are far smaller than the table, so that the first graph is poor; odd vectors."""

import math

import numpy as np
import pytest

from stratapoint.llm import neighbours

VECTORS = "vec_id long, embedding array<double>"


def recall(spark, x, every=100, **how):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    found = {}
    for r in neighbours.nearest(vectors, lambda v: v % every == 0, **how).collect():
        assert math.isclose(r.score, float(x[r.query_id] @ x[r.vec_id]), rel_tol=1e-9)
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    out = hits / (20 * len(range(0, len(x), every)))
    print("recall", out)
    return out


@pytest.fixture(scope="module")
def directions():
    x = np.random.default_rng(1).standard_normal((5_000, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_does_not_rest_on_the_first_graph(spark, directions):
    assert recall(spark, directions, trees=2, group=64, beam=64) >= 0.9


def test_one_enormous_vector_blurs_no_others(spark, directions):
    x = directions.copy()
    x[17] *= 1e6
    assert recall(spark, x, trees=2, group=64, beam=64) >= 0.9


def test_clusters_of_all_norms(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 24))
    x = centers[rng.integers(40, size=3_000)] + 0.3 * rng.standard_normal((3_000, 24))
    x *= np.exp(0.7 * rng.standard_normal((3_000, 1)))
    assert recall(spark, x, every=50, group=64) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    usable = [(20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (3, [4.0, 4.0]), (40, [1e200, 0.0]), (5, [1e-200, 3e-200])]
    left_out = [(60, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (80, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, "theirs") for i, v in usable + left_out], f"{VECTORS}, score string")
    for rows in (vectors, vectors.orderBy("vec_id")):
        got = {}
        for r in neighbours.nearest(rows, lambda v: v % 20 == 0).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        want = {}
        for q, x in usable:
            if q % 20 == 0:
                best = sorted((-float(np.dot(x, y)), i) for i, y in usable if i != q)
                want[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
        assert {q: sorted(v) for q, v in got.items()} == want
    assert neighbours.nearest(vectors.limit(0), lambda v: v % 20 == 0).count() == 0
    alone = neighbours.nearest(vectors.where("vec_id = 20"), lambda v: v % 20 == 0)
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(1000 + i, [math.cos(i), math.sin(i), 0.5]) for i in range(200)]
    out = neighbours.nearest(spark.createDataFrame(rows, VECTORS), lambda v: v % 100 == 0, group=32).collect()
    for q in (0, 100, 200):
        got = sorted((r["rank"], r.vec_id) for r in out if r.query_id == q)
        assert [i for _, i in got] == [i for i in range(22) if i != q][:20]


def test_spread_out_vectors_with_the_parameters_of_the_query(spark, tmp_path, caplog):
    """30,000 vectors of no structure at all: searches widen until the sampled recall is reached."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 30_000
    x = np.random.default_rng(3).standard_normal((n, 64)).astype("f4")
    for i in range(8):
        own = np.arange(n)[i::8]
        pq.write_table(pa.table({"vec_id": own, "embedding": pa.array(list(x[own]), pa.list_(pa.float32()))}), tmp_path / f"{i}.parquet")
    with caplog.at_level("INFO", logger=neighbours.__name__):
        out = neighbours.nearest(spark.read.parquet(str(tmp_path)), lambda v: v % 200 == 0).toPandas()
    told = [r.args[:2] for r in caplog.records if "beam" in r.msg]
    assert told[-1][1] >= neighbours.TARGET and [b for b, _ in told] == [neighbours.BEAM * neighbours.WIDER**i for i in range(len(told))]
    hits = 0
    for q, rows in out.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len(set(np.argpartition(-score, 20)[:20].tolist()) & set(rows.vec_id))
    assert hits / (20 * out.query_id.nunique()) >= 0.9
