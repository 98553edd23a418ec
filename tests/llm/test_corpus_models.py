"""Phrases, clusters and language-model scores against SQL, plain Python and the laws of probability."""

import math
import re
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent.parent)]

from compare import same_rows  # noqa: E402

from stratapoint.llm import clusters, mixing, phrases  # noqa: E402


@pytest.mark.parametrize("name", ["op11_phrases", "op12_clusters"])
def test_query_equals_sql(spark, sf, name):
    from stratapoint.llm.registry import ORACLES, QUERIES

    same_rows(QUERIES[name](spark, sf), ORACLES[name], sf)


TEXTS = [
    ("en", "New  York\tCity, new york CITY! new york city\nnew york"), ("en", "the big apple is new york city. the big apple"), (None, "a b a b a b a b"),
    ("und", "a b; b a"), ("fr", None), ("fr", ""), ("fr", "É é É x é\x0bÉ é"), ("en", "x" * 5000 + " " + "the big apple " * 300),
]


def plain_phrases(rows, max_words, min_count, cover, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] = f.get((lang, tuple(words[i : i + k])), 0) + 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        inside = any(x == lang and len(q) > len(p) and b >= min_count and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in f.items())
        if not inside:
            cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1] :]], n[lang]))
    ranked, last = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        last[lang] += 1
        if last[lang] <= top:
            ranked.append((lang, last[lang], p.decode(), -a, left, right, total, -score))
    return ranked


@pytest.mark.parametrize("min_count, cover, top", [(2, 80, 100), (1, 50, 3), (3, 100, 5)])
def test_phrases_equal_plain_python(spark, monkeypatch, min_count, cover, top):
    monkeypatch.setattr(phrases, "PORTION", 40)  # texts are cut between pieces
    docs = spark.createDataFrame(TEXTS, "lang string, text string").withColumn("score", F.lit("theirs")).repartition(3)
    got = phrases.phrases(docs, 4, min_count, cover, top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(TEXTS, 4, min_count, cover, top)


def plain_clusters(rows, k, rounds, seed):
    import hashlib

    x = [(i, [math.floor(Fraction(v) * 1024) for v in e]) for i, e in rows]
    c = [v for _, _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), str(i), v) for i, v in x)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        c = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(x, own) if o == j))] if j in own else m for j, m in enumerate(c)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in x)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_clusters_equal_plain_python(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (scale if i % 3 else 1.0)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # ties and repeated vectors
    odd = [(200, None), (201, [1.0] * 5), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [None] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r.vec_id, r.cluster, r.distance) for r in clusters.clustered(df, 5, 4, 6).collect())
    assert got == [(i, c, d if d < 2**63 else None) for i, c, d in plain_clusters(rows, 5, 4, 3)]


def test_partial_distances_are_exact():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-4, 4, (500, 20)), rng.integers(-4, 4, (7, 20))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    found, best = clusters.nearest(x, c, 3)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_a_tree_tells_symbols_apart():
    code = mixing.Code.of([50, 1, 7, 7, 3, 20])
    paths = set()
    for s in range(6):
        at, n = code.decisions(np.array([s]))
        assert n[0] == len(at)
        paths.add(tuple(zip(code.place[at].tolist(), code.bit[at].tolist())))
    assert len(paths) == 6
    assert sum(Fraction(1, 2 ** len(p)) for p in paths) == 1
    for p in paths:  # every decision's place has two outcomes
        for place, bit in p:
            assert any((place, 1 - bit) in q for q in paths)


def test_outcomes_of_a_decision_add_up_to_one():
    rng = np.random.default_rng(6)
    mixer = mixing.Mixer.plain(mixing.Code.of([1, 1]), np.zeros((3, 1), np.int8))
    z, gate = rng.normal(size=1000).astype(np.float32) * 9, rng.integers(0, len(mixer.weights), 1000)
    one, zero = (10.0 ** mixer.log10(z, gate, np.full(1000, b, np.uint8)) for b in (1, 0))
    assert np.allclose(one + zero, 1, atol=1e-5)


def test_own_weights_look_back_only():
    """The sums up to a place do not change with what follows it, nor with the texts beside it."""
    rng = np.random.default_rng(7)
    n = 5 * mixing.BLOCK
    x, bit = rng.normal(size=(3, n)).astype(np.float32), rng.integers(0, 2, n).astype(np.uint8)
    z = x.sum(axis=0)
    whole = mixing.adapted(x, z, bit, np.array([2 * mixing.BLOCK, 3 * mixing.BLOCK]), np.zeros((2, 3), np.float32))
    alone = mixing.adapted(x[:, 2 * mixing.BLOCK :], z[2 * mixing.BLOCK :], bit[2 * mixing.BLOCK :], np.array([3 * mixing.BLOCK]), np.zeros((1, 3), np.float32))
    assert np.allclose(whole[2 * mixing.BLOCK :], alone, atol=1e-5)
    other = bit.copy()
    other[4 * mixing.BLOCK :] ^= 1
    again = mixing.adapted(x, z, other, np.array([n]), np.zeros((1, 3), np.float32))
    once = mixing.adapted(x, z, bit, np.array([n]), np.zeros((1, 3), np.float32))
    assert np.array_equal(again[: 4 * mixing.BLOCK], once[: 4 * mixing.BLOCK])


def test_stretches_hand_contexts_on():
    words = [f"w{i % 7}" for i in range(100)]
    text, numbers = " ".join(words), {f"w{i}".encode(): i + 2 for i in range(5)}
    parts = [mixing.Reader(numbers).read(g) for g in mixing.stretches([text, None])]
    reader = mixing.Reader(numbers)
    cut = [reader.read(g) for g in mixing.stretches([text, None], 30)]
    for k in range(1, mixing.WORD_CONTEXTS):
        assert np.array_equal(np.concatenate([p[1][k] for p in parts]), np.concatenate([p[1][k] for p in cut]))
    assert np.array_equal(np.concatenate([p[0] for p in parts]), np.concatenate([p[0] for p in cut]))
    assert sum(p[2].sum() for p in cut) == 102


def test_lm_base_equals_plain_python_and_model_is_better(spark, sf):
    import zlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    read = lambda t: [w for w in re.split("[ \x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    c = Counter(w for r in rows if not held[r.doc_id] for w in read(r.text))
    n, v = sum(c.values()), len(c)
    for common in (mixing.COMMON, 50):  # nearly all words in the tree, nearly all outside it
        got = {r.doc_id: r for r in mixing.scored(spark.read.parquet(f"{sf}/documents.parquet"), common).collect()}
        assert len(got) == len(rows)
        for r in rows:
            words, x = read(r.text), got[r.doc_id]
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), n)
            assert x.base_score == pytest.approx(base, rel=1e-9) and x.score < 0
        if common == mixing.COMMON:
            known = [r for r in got.values() if not r.held_out]
            assert sum(r.score for r in known) > sum(r.base_score for r in known)
            assert sum(r.bits_per_byte for r in got.values() if r.held_out) / sum(held.values()) < 3.5


def test_scores_do_not_depend_on_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    words = mixing.Language({b"the": 2, b"of": 3}, np.array([5, 0, 9, 4]), 18, 3)
    mixer = mixing.Mixer.plain(mixing.Code.of([5, 2, 9, 4]), np.random.default_rng(1).integers(-128, 127, (mixing.WORD_CONTEXTS, 1 << mixing.SLOT_BITS)).astype(np.int8))
    part = docs.withColumn("part", F.lit(1))
    a, b = ({r.doc_id: r.score for r in mixing.scored_words(part.repartition(n), words, mixer).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4) for k in a)
