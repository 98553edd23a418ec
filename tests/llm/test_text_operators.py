"""Quality, language, BPE, lines, decontamination and personal data against brute force and planted cases."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from stratapoint.llm import bpe, decontaminate, language, lines, pii, quality, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a very long text without end " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", None, 1), (4, "same", None, "a", 4), (4, "same", None, "a", 4), (None, "no id", "en", "a", 5), (5, "\n\n \t\n", "en", "a", 6), (6, "é" * 50, "fr", "b", 50)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf):
    return shared.table(spark, sf, "documents")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_bpe_equals_the_library(spark, sf, odd, none):
    import base64

    import public_tokenizers as P
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = spark.createDataFrame([(90, "  two  spaces\r\n<|endoftext|> naïve 日本語 \U0001f600́ it's WE'LL 12345", None, None, 1), (91, "aaaaaaaaaaaaaaaaaaaaab" * 40, None, None, 1)], SCHEMA)
    rng = random.Random(2)
    runs = [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(3000)))) for i, letters in enumerate(["a", "ab", "é", "the", "01", "=-", " ", "日"] * 3)]
    docs = documents(spark, sf).select("doc_id", "text").union(odd.select("doc_id", "text")).union(mixed.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame(runs, "doc_id long, text string")).withColumn("Token_IDs", F.lit(1))
    for most_common in (bpe.COMMON_WORDS, 50, 0):
        for r in bpe.encode(docs, path, pattern, decoded="decoded", most_common=most_common).collect():
            want = own.encode_ordinary(r.text or "")
            assert r.token_ids == struct.pack(f"<{len(want)}I", *want)
            assert r.decoded == (r.text or "").encode()
    assert 0 < bpe.common_words(docs, path, pattern, most=50).count() <= 50
    for r in bpe.op4_byte_bpe(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id").collect():
        want = own.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
    assert bpe.encode(none, path, pattern).count() == 0
    back = bpe.decode(bpe.encode(odd, path, pattern), path)
    assert all(r.decoded == (r.text or "").encode() for r in back.collect())


def test_one_letter_a_million_times():
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.ranks_in(path)
    ids = bpe.MergeReplay(ranks, pattern).encode(["a" * 1_000_000, "ab" * 200_000])
    token = {r: t for t, r in ranks.items()}
    for data, text in zip(ids, (b"a" * 1_000_000, b"ab" * 200_000)):
        tokens = struct.unpack(f"<{len(data) // 4}I", data)
        assert b"".join(map(token.__getitem__, tokens)) == text
    # No pair is left to merge in a run of one letter, but where the run ends.
    tokens = struct.unpack(f"<{len(ids[0]) // 4}I", ids[0])
    assert not any(token[a] + token[b] in ranks for a, b in zip(tokens, tokens[1:]))


def plain_lines(rows):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, ls in split:
        for k in {key(x) for x in ls if len(key(x)) >= 40}:
            held.setdefault(k, set()).add(d)
    out = []
    for d, ls in split:
        kept = [x for x in ls if not (len(held.get(key(x), ())) >= 5 and d != max(held[key(x)]))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_keys", [lines.HOT_KEYS, 6, 0])
def test_lines_equal_brute_force(spark, sf, odd, none, hot_keys):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    rows += [(10_000 + i, f"  {'É' * 39}Z \n{'x' * 39}\nown {i}\n{'é' * 39}z" if i % 2 else f"{'É' * 39}Z") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("theirs"))
    out = lines.dedup_lines(docs, hot_keys=hot_keys, shard_keys=3)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(rows)
    assert lines.dedup_lines(none, hot_keys=hot_keys).count() == 0
    got = lines.dedup_lines(odd, hot_keys=hot_keys)
    assert got.count() == odd.count() and got.where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("hot_keys", [lines.HOT_KEYS, 0])
def test_rows_without_an_id_lose_common_lines(spark, hot_keys):
    common = "a line that many documents have, word for word"
    rows = [(i, f"{common}\nown {i}") for i in range(5)] + [(None, f"{common}\nnobody {i % 2}") for i in range(3)] + [(3, common.upper())]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), hot_keys=hot_keys)
    want = [(i, f"own {i}") for i in range(4)] + [(4, f"{common}\nown 4"), (3, ""), (None, "nobody 0"), (None, "nobody 0"), (None, "nobody 1")]
    assert rows_of(out, "doc_id", "kept_text") == sorted(want, key=str)


def test_keys_alike_in_one_half_are_told_apart():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 20_000
    h1 = rng.integers(-(2**63), 2**63, n)
    h1[: n // 2] = h1[0]  # a perfect hash of this half alone does not exist
    h2 = rng.integers(-(2**63), 2**63, n)
    pdf = pd.DataFrame({"shard": 0, "h1": h1, "h2": h2, "n_docs": np.arange(n) + 5, "keeper": -np.arange(n)})
    index = lines.LineIndex(lines.built(pdf).to_dict("records"), 1)
    count, keeper = index.probe(h1, h2)
    assert (count == pdf["n_docs"]).all() and (keeper == pdf["keeper"]).all()
    assert not index.probe(h1, h2 + 1)[0].any()


def test_line_query_equals_sql(spark, sf):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from compare import same_rows

    same_rows(lines.op5_line_dedup(spark, sf), lines.OP5_SQL, sf)


def test_reordered_passages_are_found(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(60)) for i in range(20)]
    parts = items[3][1].split()
    turned = " ".join([*parts[40:], "between", *parts[20:40], "and", *parts[:20]])
    docs = [(1, f"{text(200)} {items[2][1].upper()} {text(100)}"), (2, f"{text(50)} {turned} {text(50)}"), (3, text(400)), (4, " ".join(items[4][1].split()[:20])), (5, None), (5, None)]
    bench = spark.createDataFrame([*items, (77, items[2][1]), (78, None), (79, "too short"), (None, "nameless " * 9)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)), bench).collect()}
    assert {d for d, r in out.items() if r.contaminated} == {1, 2}
    assert out[1].item_id == 2 and out[2].item_id == 3 and out[2].tiles == 3
    assert 0 < out[4].coverage < decontaminate.THRESHOLD
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    sent, joined = (decontaminate.overlaps(plain, bench, sent_bytes=n) for n in (decontaminate.SENT_BYTES, 0))
    ordered = lambda df: sorted((r.doc_id or 0, sorted(map(str, r.overlaps))) for r in df.collect())
    assert ordered(sent) == ordered(joined)
    nameless = decontaminate.contaminated(spark.createDataFrame([(1, "nameless " * 9)], "doc_id long, text string"), bench).first()
    assert nameless.contaminated and nameless.item_id is None and nameless["items"] == [None]
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(odd, bench).count() == odd.count()


def tiling_by_hand(text, item, tile=5):
    """Coverage of an item by longest common runs of unmarked words, sought over all pairs of places."""
    a, b = ([w for w in re.split(r"[\W_]+", x.lower()) if w] for x in (text, item))
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < tile:
            return covered / max(1, len(b))
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        covered += n


def test_coverage_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["red", "Blue", "green", "one", "two"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(8)]
    docs = [(d, ", ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for d in range(12)]
    schema = "doc_id long, text string"
    bench = spark.createDataFrame(items, "item_id long, text string")
    least = {}
    for i, text in items:
        least.setdefault(text, i)
    want = {(d, i): c for d, text in docs for item, i in least.items() if (c := tiling_by_hand(text, item)) > 0}
    for sent_bytes in (decontaminate.SENT_BYTES, 0):
        out = decontaminate.overlaps(spark.createDataFrame(docs, schema), bench, sent_bytes=sent_bytes)
        assert {(r.doc_id, x.item_id): x.coverage for r in out.collect() for x in r.overlaps} == pytest.approx(want)


def test_decontamination_query_names_what_it_covers(spark, sf):
    items = {r.item_id: r.text for r in shared.table(spark, sf, "benchmark").collect()}
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    out = {r.doc_id: r for r in decontaminate.op6_decontamination(spark, sf).collect()}
    for d, text in docs.items():  # an item that stands whole in a text
        whole = [i for i, x in items.items() if len(x.split()) >= 5 and x in text]
        if whole:
            assert d in out and set(map(str, whole)) <= set(out[d].item_ids.split(","))
    for d, r in list(out.items())[:3]:
        assert r.coverage >= decontaminate.THRESHOLD


def test_language_on_held_out_rows(spark, sf, odd, none):
    docs = documents(spark, sf)
    out = language.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    model = language.learn(docs, F.lit(True))
    found = language.identify(odd.withColumn("LANG_PRED", F.lit(1)), model)
    assert found.count() == odd.count()
    assert {r.lang_pred for r in found.where("doc_id in (1, 2, 5)").collect()} == {"und"}
    nothing = language.learn(none, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_quality_on_held_out_rows(spark, odd, none):
    docs = "/root/testdata/sf0.01"
    out = quality.op1_quality(spark, docs)
    labels = shared.table(spark, docs, "labels").where("quality is not null")
    held = out.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.85
    assert out.where("score < 0 or score > 1 or score is null or predicted is null").count() == 0
    with_stats = quality.statistics(odd.withColumn("stat_chars", F.lit(-1.0)))
    assert with_stats.count() == odd.count() and with_stats.where("stat_chars < 0").count() == 0
    one_kind = quality.learn(with_stats.withColumn("label", F.lit(1.0)))
    assert with_stats.select(one_kind.score().alias("s")).where("s > 0.5").count() == odd.count()
    assert quality.statistics(none).count() == 0


def base_by_hand(text):
    passing = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub(r"[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
        "phone": lambda s: 8 <= len(re.sub(r"[^0-9]", "", s)) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if passing[k](m[0])]


def test_personal_data_equals_patterns(spark, sf, odd, none):
    texts = ["mail a.b@c.de, x@y, 1.2.3.4 256.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 0" + "1" * 30, "é +49 (30) 123-4567 +1 2 +123456789012345678", "a@b.c@d.e +1.2.3.4 ..@a.b", "9" * 5000 + "@x" * 500]
    docs = documents(spark, sf).select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = pii.find(docs.withColumn("SPANS", F.lit(0)), pii.learn(docs))
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base_by_hand(r.text)
        assert all(0 <= s.start < s.end <= len(r.text) for s in r.spans)
    assert pii.find(none, pii.learn(none)).count() == 0


def test_query_digests(spark, sf):
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    for r in pii.op10_pii(spark, sf).collect():
        want = base_by_hand(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    for r in bpe.op4_byte_bpe(spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
