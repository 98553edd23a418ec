"""The pipeline's near-duplicate stage against brute force on 5-word shingles."""

import random

import pytest

from stratapoint.llm import shared, similar

DOCS = "doc_id long, text string, lang string"


def shingles_by_hand(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def links_by_hand(texts):
    sets = {t: shingles_by_hand(t) for t in {t or "" for t in texts}}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def rows(spark, sf):
    found = [(r.doc_id, r.text) for r in shared.table(spark, sf, "documents").collect()]
    rng = random.Random(3)
    template = [f"w{i}" for i in range(60)]
    for i in range(120):  # edits of one text, on both sides of the threshold
        words = list(template)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        found.append((700_000 + i, " ".join(words)))
    return found + [(800_001, None), (800_002, " \n"), (800_003, "Two words"), (800_004, "two  words"), (800_005, "two"), (800_006, "word " * 30_000)]


@pytest.mark.parametrize("sample_rows, block_shingles", [(4_096, 1_000_000), (0, 300)])
def test_links_equal_brute_force(spark, rows, sample_rows, block_shingles):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text_of = {r.k: r.text or "" for r in docs.select(similar.text_key().alias("k"), "text").collect()}
    got = [tuple(sorted((text_of[r.u], text_of[r.v]))) for r in similar.similar_links(docs, sample_rows=sample_rows, block_shingles=block_shingles).collect()]
    assert len(got) == len(set(got))
    assert set(got) == links_by_hand([t for _, t in rows])
    assert similar.similar_links(docs.limit(0)).count() == 0


def test_stage_keeps_the_first_of_each_group(spark, rows, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    # One doc_id with two texts, one of them a copy of another document's, and rows that are there twice.
    extra = [(900_001, "a text of its own with eight words"), (900_001, rows[0][1]), (900_002, "another text that is quite alone"), (900_002, "another text that is quite alone"), (None, rows[0][1])]
    all_rows = [(d, t, "en") for d, t in [*rows, *extra]]
    root = {t or "": t or "" for _, t, _ in all_rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links_by_hand(list(root)):
        root[find(a)] = find(b)
    first = {}
    for d, t, _ in all_rows:
        if d is not None:
            first[find(t or "")] = min(d, first.get(find(t or ""), d))
    out = pipeline.one_of_each_group(spark, spark.createDataFrame(all_rows, DOCS), sf).collect()
    kept = [(r.doc_id, find(r.text or "")) for r in out if r.doc_id is not None]
    assert sorted(kept) == sorted((d, g) for g, d in first.items())
    assert [r.text for r in out if r.doc_id is None] == [rows[0][1]]


@pytest.mark.parametrize("turns, many", [(0, 32), (8, 32), (8, 2)])
def test_classes_equal_brute_force(spark, rows, monkeypatch, turns, many):
    monkeypatch.setattr(similar, "MANY", many)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key_of = {r.text or "": r.k for r in docs.select(similar.text_key().alias("k"), "text").collect()}
    root = {k: k for k in key_of.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links_by_hand(list(key_of)):
        one, other = sorted((find(key_of[a]), find(key_of[b])))
        root[other] = one  # the smaller key names the class
    linked = {find(k) for k in root if find(k) != k}
    expected = {(k, find(k)) for k in root if find(k) in linked}
    assert {tuple(r) for r in similar.similar_groups(docs, turns=turns).collect()} == expected
    assert similar.similar_groups(docs.limit(0), turns=turns).count() == 0


def test_the_simhash_operator_finds_the_first_links(spark, rows, monkeypatch):
    from stratapoint.llm import simhash

    docs = spark.createDataFrame(rows, "doc_id long, text string").select(similar.text_key().alias("key"), "text")
    text_of = {r.key: r.text or "" for r in docs.collect()}
    good = {tuple(sorted(p)) for p in links_by_hand(list(text_of.values()))}
    found = {tuple(sorted((text_of[r.u], text_of[r.v]))) for r in similar.fingerprint_links(docs, similar.SHINGLE, similar.BLOCK_SHINGLES).collect()}
    assert found and found <= good
    mark = {t: simhash.fingerprint(t, similar.SHINGLE) for t in text_of.values()}
    assert all(((mark[a] ^ mark[b]) & (2**64 - 1)).bit_count() <= simhash.RADIUS for a, b in found)
    asked = []
    monkeypatch.setattr(similar, "near_links", lambda distinct, radius: asked.append(radius) or simhash.near_links(distinct, radius))
    similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert asked == [simhash.RADIUS]
