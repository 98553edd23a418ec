"""Near duplicates, shards, neighbours and training order against brute force; the pipeline stage by stage."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratapoint.llm import neighbours, sharding, shared, simhash, training_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def print_by_hand(text):
    words = [w for w in (text or "").translate(str.maketrans({chr(c): " " for c in (9, 10, 11, 12, 13)})).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(rows):
    prints = [(d, print_by_hand(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


def test_near_duplicates_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, sf, "documents").collect()]
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    rows += [(900_001, None), (900_002, ""), (900_003, " \t\n"), (900_003, " \t\n"), (None, rows[0][1]), (900_004, long), (900_005, long + " End"), (900_006, "É a B"), (900_007, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("theirs"))
    out = simhash.near_duplicates(docs, sample_rows=64, shard_rows=16).collect()
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out), key=str)
    assert got == groups_by_hand(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_the_query_names_groups_like_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, sf, "documents").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()), key=str)
    assert got == groups_by_hand(rows)


def linked_by_hand(prints):
    root = np.arange(len(prints))
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
        roots = np.unique(root[near])
        root[np.isin(root, roots)] = roots[0]
    return root


@pytest.mark.parametrize("equal", ["low", "high", "neither"])
def test_large_shards_are_split_again(spark, equal):
    """Fingerprints that agree in a half, which no tree over that half can split."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, 250, dtype=np.uint64)
    half = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 32, 250, dtype=np.uint64)) for _ in range(4)] + [base])
    other = np.uint64(0xABCDEF01) if equal != "neither" else rng.integers(0, 2**32, len(half), dtype=np.uint64)
    prints = np.unique(half << np.uint64(32) | other if equal == "low" else other << np.uint64(32) | half)
    distinct = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.near_links(distinct, sample_rows=64, shard_rows=16, own_sample=64, portion=50).collect()
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in links)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(place[r.u])] = find(place[r.v])
    want = linked_by_hand(prints)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(int(want[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(np.unique(want))


def test_groups_without_ids_do_not_fuse(spark):
    long_texts = [" ".join(f"{w}{i}" for i in range(400)) for w in "abcd"]
    near = [t.replace("7 ", "7x ", 1) for t in long_texts]
    rows = [(None, long_texts[0]), (5, near[0]), (None, long_texts[1]), (9, near[1]), (None, long_texts[2]), (7, long_texts[3]), (7, long_texts[0])]
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == groups_by_hand(rows)


def test_shards_interleave_sources(spark, sf):
    docs = shared.table(spark, sf, "documents").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(None, None, None), (7, "", "hot"), *[(8, "same", "hot")] * 90], "doc_id long, text string, source string"))
    rows = sharding.interleave(docs, bucket_rows=16).collect()
    assert len(rows) == docs.count()
    by_shard = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    # After every shard all sources have come equally far, to within one row of each.
    total = {x: sum(r.source == x for r in rows) for x in {r.source for r in rows}}
    for s in range(24):
        far = {x: sum(r.source == x and r.shard <= s for r in rows) / n for x, n in total.items()}
        assert all(abs(far[a] - far[b]) <= 1 / total[a] + 1 / total[b] + 1e-9 for a in total for b in total)
    hot = [sum(r.source == "hot" for r in rows if r.shard == s) for s in range(24)]
    assert max(hot) - min(hot) <= 5
    assert sharding.interleave(docs.limit(0)).count() == 0


def test_neighbours_are_found_and_scored_exactly(spark):
    sf = "/root/testdata/sf0.01"
    out = neighbours.op8_neighbours(spark, sf).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in shared.table(spark, sf, "embeddings").collect() if r.embedding and None not in r.embedding}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    queries = [i for i in rows if i % 20 == 0]
    found, wanted = {}, 0
    for r in out:
        assert r.query_id != r.vec_id and abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-9
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = 0
    for q in queries:
        best = sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20]
        hits += len({v for _, v in found[q]} & set(best))
        wanted += len(best)
        assert sorted(n for n, _ in found[q]) == list(range(1, 21))
    assert hits / wanted >= 0.9


def test_slots_are_a_permutation():
    for n in (1, 2, 5, 1000):
        slots = training_order.permuted(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert training_order.permuted(slots, n, back=True).tolist() == list(range(n))


def read_back(path, places, width, **how):
    n = max(p.slot for p in places) + 1
    slots = np.array(list(training_order.read_slots(path, 0, n, width=width, **how)))
    end, pad = training_order.marks(width)
    stream = slots[training_order.permuted(np.arange(n), n)].reshape(-1)
    stream = stream[: len(stream) - int((stream[::-1] != pad).argmax())]
    return slots, [x[:-1] for x in np.split(stream, np.flatnonzero(stream == end) + 1)[:-1]]


def test_sequences_read_back(spark, sf, tmp_path):
    docs = shared.table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(None, None), (5, ""), (6, "x" * 300_000), (6, "x" * 511), (6, "x" * 511)], "doc_id long, text string"))
    rows = training_order.byte_ids(docs).withColumn("Slot", F.lit("theirs"))
    how = {"length": 512, "shard_slots": 64}
    places = training_order.materialise(rows, str(tmp_path), **how).collect()
    slots, found = read_back(str(tmp_path), places, 1, **how)
    assert sorted(x.tobytes() for x in found) == sorted((r.text or "").encode() for r in docs.collect())
    later = np.array(list(training_order.read_slots(str(tmp_path), 70, 75, **how)))
    assert (later == slots[70:75]).all()
    assert sum(p.n_ids for p in places) == sum(len(x) + 1 for x in found)
    for p in places[:50]:  # the columns name the very bytes
        with open(p.path, "rb") as f:
            f.seek(p.byte_offset)
            assert f.read(p.n_ids) == slots[p.slot][p.position : p.position + p.n_ids].tobytes()
    assert training_order.materialise(training_order.byte_ids(docs.limit(0)), str(tmp_path / "none")).count() == 0


def test_the_query_writes_every_token_id(spark, sf):
    import base64

    import public_tokenizers as P
    import tiktoken

    places = training_order.op9_training_order(spark, sf).collect()
    folder = places[0].path.removeprefix("file://").rpartition("/")[0]
    _, found = read_back(folder, places, 2)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: own.encode_ordinary(r.text or "") for r in shared.table(spark, sf, "documents").collect()}
    assert sorted(x.tolist() for x in found) == sorted(docs.values())
    of_doc = {}
    for p in places:
        of_doc[p.doc_id] = of_doc.get(p.doc_id, 0) + p.n_ids
    assert of_doc == {d: len(x) + 1 for d, x in docs.items()}


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline_stages_keep_columns_and_decide(spark, sf, pipeline):
    docs = shared.table(spark, sf, "documents").withColumn("_lang_score", F.lit(1)).withColumn("kept_text", F.lit("theirs"))
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        after = shared.stored(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    groups = groups_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert 0.5 * before < docs.count() and all(d == c for d, _, c in groups)
    out = pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("NOT round_trip").count() == 0
