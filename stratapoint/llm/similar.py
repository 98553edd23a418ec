"""Texts whose sets of word shingles have a Jaccard similarity of at least 4/5: an exact similarity join.

SimHash alone cannot stand in for this join: at a similarity of 0.8 two 64-bit fingerprints differ in about 10 bits and
often in far more, and with so wide a radius a vantage-point tree rules nothing out. Here all shingles stand in one order.
Two sets that share four fifths of their union share a shingle among the first n - ceil(4n / 5) + 1 of each, so
only these prefixes are shuffled, and only prefix shingles of two different texts make candidate pairs. Sizes and places rule out
many of them. Shingles that a sample finds in many texts
come last in the order. Candidates are first held against parity sketches, one bit for each shingle or so, which bound the
difference of two sets from below, and those left against the whole sets. The sample (about SAMPLE_ROWS texts) bears on speed alone: any order gives the same pairs.

`similar_groups` begins with the SimHash operator: texts whose 64-bit fingerprints of the same shingles its vantage-point trees find within
RADIUS bits are held against each other, and those that are similar make the first classes; the join then has the rest to find.

`similar_links` gives every link, `similar_groups` the classes that they make. Classes need a forest only: shingles of many
texts are first joined with one pivot of a size at a time, until few pairs of different classes are left, and only pairs of texts that are not
yet of one class are then held against each other, all of them, with small sketches in the join itself. So a group of copies costs rows by its size and not by its square.

Words are those of the SimHash operator. Texts of fewer words than a shingle are one shingle, and texts without words,
null ones among them, equal each other. A text is named by its 64-bit hash, so that equal texts are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components
from .shared import forget, slices, stored
from .simhash import RADIUS, fingerprint, near_links

SHINGLE = 5
SEED = 42
#: Texts on which frequent shingles are looked for, about; texts of these that make a shingle frequent; shingles kept.
SAMPLE_ROWS, FREQUENT, KEPT = 4_096, 3, 200_000
#: Shingles that either side of a block of candidate pairs holds, about.
BLOCK_SHINGLES = 1_000_000
#: Candidates whose keys are sent to all tasks; more are joined by a shuffle of the texts.
SENT_KEYS = 1_000_000
#: Texts of a shingle from which pivots are used; pairs for each row of such shingles that are few enough to be held against each other.
MANY, FEW_PAIRS = 32, 2
#: A turn of pivots that leaves more than this share of the pairs is the last.
LEFT = 0.8
#: Words of 64 bits of the small sketches that texts of frequent shingles bring to the join.
SMALL_SKETCH = 4
#: Two sizes of one band are within 4/5 of each other, but for rounding.
BAND = 1.25


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values of the text's shingles, in order."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[min(shingle, len(words)) - 1 :].tolist() if words else [0]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n / 5) + 1 shingles, rare ones first."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.lexsort((found, np.where(frequent[at] == found, counts[at], 0)))]
    return found[: len(found) - -(-4 * len(found) // 5) + 1]


def sketch(found: np.ndarray) -> bytes:
    """Bits for the shingles' values modulo a power of two, as many as shingles at least; a bit is the parity of its shingles."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """At most the number of shingles that one of two sets has alone."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def may_be_similar(a: bytes, b: bytes, n: int, m: int) -> bool:
    return 9 * difference(a, b) <= n + m


def are_similar(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (n + m)


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("key"), F.col("n_u").alias("n")).union(pairs.select("v", "n_v")).distinct()


def packed(text: str | None) -> bytes:
    """The text's words, which shrink to a third of its shingles."""
    return zstandard.compress(b" ".join((text or "").encode().lower().split()))


def unpacked(data: bytes, shingle: int) -> np.ndarray:
    return shingles(zstandard.decompress(data).decode(), shingle)


def decided(pairs: DataFrame, held: DataFrame, test, units: int, block_units: int, read=lambda data: data) -> DataFrame:
    """The pairs u, v, n_u, n_v that pass a test of what `read` makes of held's `data`. units: what all data come to, in those of block_units.

    Pairs are decided in blocks of a grid, so that a text of many pairs is sent once to each block it has a pair in.
    """
    side = max(1, -(-units // block_units))
    block = F.pmod(F.xxhash64("u"), F.lit(side)) * side + F.pmod(F.xxhash64("v"), F.lit(side))
    pairs = pairs.withColumn("block", block)
    places = pairs.select(F.col("block").alias("at_block"), F.col("u").alias("key")).union(pairs.select("block", "v")).distinct()

    def decide(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of = {key: read(data) for key, data in zip(held["key"].tolist(), held["data"])}
        good = [test(of[u], of[v], n, m) for u, v, n, m in zip(*(pairs[c].tolist() for c in ("u", "v", "n_u", "n_v")))]
        return pairs.loc[np.array(good, bool), ["u", "v", "n_u", "n_v"]]

    return pairs.groupBy("block").cogroup(places.join(held, "key").groupBy("at_block")).applyInPandas(decide, "u long, v long, n_u int, n_v int")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def frequent_shingles(texts: DataFrame, shingle: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of the sample, in order, and their counts."""
    drawn = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 40)) < int(sample_rows / max(1, texts.count()) * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], ["token"])

    sample = texts.where(drawn).dropDuplicates(["key"]).select("text").mapInArrow(run, "token long")
    rows = sample.groupBy("token").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count")).limit(KEPT).collect()
    tokens, counts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def shared_shingles(texts: DataFrame, shingle: int, sample_rows: int) -> DataFrame:
    """token, key, n, at: the prefix shingles that two different texts have, with the size of each text's set and the shingle's place in its order."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle, sample_rows))  # at most KEPT shingles

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column("key").to_numpy()
            for key, t in zip(keys, batch.column("text").to_pylist()):
                found = shingles(t, shingle)
                first = prefix(found, *sent.value)
                n = len(first)
                columns = [first.view(np.int64), np.full(n, key), np.full(n, len(found)), np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c, pa.int32()) for c in columns[2:]], ["token", "key", "n", "at"])

    tokens = texts.mapInArrow(prefixes, "token long, key long, n int, at int")
    holders = Window.partitionBy("token")
    shared = tokens.withColumn("_least", F.min("key").over(holders)).withColumn("_most", F.max("key").over(holders))
    return stored(shared.where("_least <> _most").drop("_least", "_most").distinct(), "shared-shingles")


def candidates(one: DataFrame, other: DataFrame, once: str) -> DataFrame:
    """u, v, n_u, n_v of pairs that one and other have a shingle for, where `once` holds and sizes and places do not rule them out."""
    one, other = (x.select("token", *(F.col(c).alias(f"{c}_{side}") for c in x.columns if c != "token")) for x, side in ((one, "u"), (other, "v")))
    pairs = one.join(other, "token").where(f"({once}) AND 5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)")
    # The smaller key comes first, so that all that two texts share is counted together.
    first = F.col("key_u") < F.col("key_v")
    ends = [F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}")).alias(name) for name, c, a, b in (
        ("u", "key", "u", "v"), ("v", "key", "v", "u"), ("n_u", "n", "u", "v"), ("n_v", "n", "v", "u"), ("at_u", "at", "u", "v"), ("at_v", "at", "v", "u"),
    )]
    pairs = pairs.select(*ends).groupBy("u", "v", "n_u", "n_v").agg(F.count(F.lit(1)).alias("c"), F.max("at_u").alias("at_u"), F.max("at_v").alias("at_v"))
    # All that is common up to the last common place has been counted.
    pairs = pairs.where("9 * (c + least(n_u - 1 - at_u, n_v - 1 - at_v)) >= 4 * (n_u + n_v)")
    return stored(pairs.select("u", "v", "n_u", "n_v"), "candidates")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, block_shingles: int) -> DataFrame:
    """u and v of the pairs (stored; u, v, n_u, n_v) whose similarity is 4/5 or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = batch.column("text").to_pylist()
            columns = [pa.array([sketch(shingles(t, shingle)) for t in held], pa.binary()), pa.array(map(packed, held), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "sketch", "words"])

    nodes = nodes_of(pairs)
    count, units = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys = nodes.select("key")
    wanted = texts.join(F.broadcast(keys) if count <= SENT_KEYS else keys, "key", "left_semi")
    found = stored(wanted.select("key", "text").mapInArrow(sets, "key long, sketch binary, words binary").dropDuplicates(["key"]), "shingle-sets")
    # A sketch has at most two bits for each shingle, a shingle 64 of its own.
    likely = stored(decided(pairs, found.select("key", F.col("sketch").alias("data")), may_be_similar, units, 32 * block_shingles), "likely")
    units = nodes_of(likely).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = found.select("key", F.col("words").alias("data"))
    return decided(likely, words, are_similar, units, block_shingles, lambda data: unpacked(data, shingle)).select("u", "v")


def similar_links(docs: DataFrame, shingle: int = SHINGLE, sample_rows: int = SAMPLE_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """u and v, keys of texts of similarity 4/5 or more; every such pair of different keys, once."""
    texts = docs.select(text_key().alias("key"), "text")
    shared = shared_shingles(texts, shingle, sample_rows)
    return verified(candidates(shared, shared, "key_u < key_v"), texts, shingle, block_shingles)


def with_home(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """shared with each text's class, and of each shingle the most frequent class, its number of texts and of pairs of unlike classes.

    Shingles whose texts are all of one class are left out: no pair of theirs can join classes.
    """
    if groups is None:
        held = shared.withColumn("class", F.col("key"))
    else:
        held = shared.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key")).drop("component")
    of = held.groupBy("token", "class").agg(F.count(F.lit(1)).alias("texts"))
    squares = F.sum(F.col("texts") * F.col("texts"))
    of = of.groupBy("token").agg(F.max(F.struct("texts", "class"))["class"].alias("home"), F.sum("texts").alias("texts"), squares.alias("squares"), F.count(F.lit(1)).alias("classes"))
    of = of.where("classes > 1").select("token", "home", "texts", F.expr("(texts * texts - squares) / 2").alias("unlike"))
    return stored(held.join(of, "token"), "classed-shingles")


def pivot_pairs(classed: DataFrame, turn: int) -> DataFrame:
    """Each text of a frequent shingle with one text of the shingle and of about its size, another one each turn; one pair for each row at most."""
    many = classed.where(F.col("texts") > MANY).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))))
    pivots = many.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "n", "at", "class")).alias("pivot"))
    rows = many.join(pivots, ["token", "band"]).where("class <> pivot.class AND 5 * least(n, pivot.n) >= 4 * greatest(n, pivot.n)")
    # At most the places up to this shingle and those after it are common.
    rows = rows.where("9 * (least(at, pivot.at) + 1 + least(n - 1 - at, pivot.n - 1 - pivot.at)) >= 4 * (n + pivot.n)")
    first = F.col("key") < F.col("pivot.key")
    ends = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(name) for name, a, b in (("u", "key", "pivot.key"), ("v", "pivot.key", "key"), ("n_u", "n", "pivot.n"), ("n_v", "pivot.n", "n"))]
    return stored(rows.select(*ends).distinct(), "pivot-pairs")


def with_small_sketch(classed: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """classed with 256 parities, s0 to s3, of each text that has a frequent shingle, null for others."""
    names = [f"s{i}" for i in range(SMALL_SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 64 * SMALL_SKETCH
        for batch in slices(batches):
            held = np.zeros((batch.num_rows, bits), np.uint8)
            for row, t in zip(held, batch.column("text").to_pylist()):
                row[:] = np.bincount((shingles(t, shingle) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            words = np.packbits(held, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(words[:, i]) for i in range(SMALL_SKETCH))], ["key", *names])

    keys = classed.where(F.col("texts") > MANY).select("key").distinct()
    sketches = texts.join(keys, "key", "left_semi").mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names)).dropDuplicates(["key"])
    return classed.join(stored(sketches, "small-sketches"), "key", "left")


def fingerprint_links(texts: DataFrame, shingle: int, block_shingles: int, radius: int = RADIUS) -> DataFrame:
    """u and v of similar texts that the SimHash operator finds: texts of one fingerprint with its first text, and the first texts of fingerprints that its trees link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = batch.column("text").to_pylist()
            columns = [pa.array([fingerprint(t, shingle) for t in held], pa.int64()), pa.array([len(shingles(t, shingle)) for t in held], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "fp", "n"])

    marked = stored(texts.select("key", "text").mapInArrow(run, "key long, fp long, n int").dropDuplicates(["key"]), "text-fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first")).select("fp", "first.*"), "first-texts")
    of = lambda c: first.select(F.col("fp").alias(c), F.col("key").alias(f"key_{c}"), F.col("n").alias(f"n_{c}"))
    linked = near_links(first.select("fp"), radius).join(of("u"), "u").join(of("v"), "v")
    alike = marked.join(first.select("fp", F.col("key").alias("key_v"), F.col("n").alias("n_v")), "fp").where("key <> key_v")
    pairs = linked.select("key_u", "n_u", "key_v", "n_v").union(alike.select("key", "n", "key_v", "n_v")).where("5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)")
    less = F.col("key_u") < F.col("key_v")
    ends = [F.when(less, F.col(a)).otherwise(F.col(b)).alias(name) for name, a, b in (("u", "key_u", "key_v"), ("v", "key_v", "key_u"), ("n_u", "n_u", "n_v"), ("n_v", "n_v", "n_u"))]
    return stored(verified(stored(pairs.select(*ends).distinct(), "fingerprint-pairs"), texts, shingle, block_shingles), "fingerprint-links")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, sample_rows: int = SAMPLE_ROWS, block_shingles: int = BLOCK_SHINGLES, turns: int = 8) -> DataFrame:
    """node and component: keys of texts that links of similarity 4/5 or more join, with the smallest key of their class; texts without links are not in it.

    turns bears on speed alone: whatever they have joined, every pair of texts of unlike classes is examined in the end.
    """
    texts = docs.select(text_key().alias("key"), "text")
    shared = shared_shingles(texts, shingle, sample_rows)
    links, before = fingerprint_links(texts, shingle, block_shingles), float("inf")
    groups = stored(connected_components(links), "classes")
    links = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
    classed = with_home(shared, groups)
    for turn in range(turns):
        # Every row of a shingle tells of its pairs, so each counts for its share.
        share = F.coalesce(F.sum(F.col("unlike") / F.col("texts")), F.lit(0.0))
        rows, unlike = classed.where(F.col("texts") > MANY).agg(F.count(F.lit(1)), share).first()
        if unlike <= FEW_PAIRS * rows or unlike > LEFT * before:
            break
        before = unlike
        more = stored(verified(pivot_pairs(classed, turn), texts, shingle, block_shingles), "pivot-links")
        if more.isEmpty():
            break
        # Classes so far, as links to their smallest key, stand for all links found.
        groups = stored(connected_components(links.union(more)), "classes")
        links = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        forget(classed)
        classed = with_home(shared, groups)
    classed = with_small_sketch(classed, texts, shingle)
    differ = " + ".join(f"bit_count(s{i}_u ^ s{i}_v)" for i in range(SMALL_SKETCH))
    unlike = f"class_u <> class_v AND (class_v = home_v OR key_u < key_v) AND coalesce(9 * ({differ}) <= n_u + n_v, true)"
    last = verified(candidates(classed.where("class <> home"), classed, unlike), texts, shingle, block_shingles)
    return connected_components(links.union(last))
