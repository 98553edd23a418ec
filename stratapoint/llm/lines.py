"""Line dedup through a sharded minimal perfect hash.

Line keys are counted by document with two aggregations, each of which sums before it shuffles, so
that a line found everywhere is no hot key. The keys that reach `min_docs` (no other key decides
anything, so the index leaves them out) go into shards; each shard is a minimal perfect hash by
hash-and-displace over three arrays: a 64-bit fingerprint of each key, the number of its documents, and the
document that keeps it. With the other 64 bits, which choose the slot, a wrong match has odds of 2^-64 a probe.

Documents probe the arrays. Of all the (document, key) pairs of indexed keys, at most `hot_keys` keys can hold
one in `hot_keys` of them or more each: these hot keys have shards of their own, sent to every task, 24 bytes a key and
so no more than about 30 MB at any size of the corpus. The other keys are in few documents each; where there are any, probes that
the hot shards do not answer are dealt out by shard, each shard's probes stream past its arrays in one pass, and only the
decisions come back to the documents.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased. Keys of at
least `min_chars` code points found in at least `min_docs` documents lose all their lines except in the
largest doc_id that holds them. Null or empty texts are one empty line. A null doc_id is a document
that never keeps. Repeated rows of a doc_id are one document, and each row is treated alike. An empty
table gives an empty result. All columns of the input stay, but for those named like a result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import slices, stored, unused

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a shard, on average, and documents whose probes go to a shard at least.
SHARD_KEYS, SHARD_DOCS = 32_768, 16_384
#: The most keys that are sent to every task.
HOT_KEYS = 1 << 20
#: Seeds tried for a bucket of keys before the whole shard is hashed anew, and how often that may be.
SEEDS, SALTS = 1 << 16, 64
STRIPPED = b" \t\n\x0b\x0c\r"
NOBODY = -(2**63)

ARRAYS = ("seeds", "fingerprints", "counts", "keepers")
INDEX = T.StructType([T.StructField("shard", T.LongType()), T.StructField("salt", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ARRAYS)])


def keyed(text: str | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, and position and hash of those long enough to count."""
    lines = (text or "").encode().split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(STRIPPED).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(key))
    return lines, at, keys


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mixed(key: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Unsigned numbers spread evenly, another order for each seed."""
    x = key.astype(np.uint64) ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def single(h1: np.ndarray, h2: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Both halves of keys as one number, another one for each salt."""
    return mixed(h1.astype(np.uint64) ^ mixed(h2, salt), salt)


def minimal_perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Seeds by bucket and the slot of each of the distinct keys, or nothing where SEEDS do not do. A seed below zero names the slot of a single key."""
    n = len(keys)
    buckets = max(1, n // 3)
    bucket = (mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    seeds, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
    free = np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[starts[b] : starts[b] + sizes[b]]
        if len(own) < 2:
            break
        first, tries = 1, 8
        while first < SEEDS:  # more and more seeds at once
            tried = np.arange(first, first + tries, dtype=np.uint64)
            to = (mixed(keys[own][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[to].all(axis=1)
            good[good] = (np.diff(np.sort(to[good], axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                break
            first, tries = first + tries, min(2 * tries, 1024)
        else:
            return None
        at = int(good.argmax())
        seeds[b], slots[own] = int(tried[at]), to[at]
        free[to[at]] = False
    alone = order[starts[sizes == 1]]
    to = np.flatnonzero(free)
    seeds[bucket[alone]], slots[alone] = -to - 1, to
    return seeds, slots


def built(pdf: pd.DataFrame) -> pd.DataFrame:
    """The arrays of a shard's keys."""
    h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
    for salt in range(1, SALTS):
        keys = single(h1, h2, salt)
        if len(np.unique(keys)) == len(keys) and (found := minimal_perfect_hash(keys)):
            break
    else:  # the keys differ, so each salt fails by itself, with odds far below one in a thousand
        raise RuntimeError("no perfect hash of a shard")
    seeds, slots = found
    arrays = np.empty((3, len(pdf)), "<i8")
    arrays[:, slots] = h2, pdf["n_docs"], pdf["keeper"]
    return pd.DataFrame([[int(pdf["shard"].iloc[0]), salt, seeds.astype("<i8").tobytes(), *(a.tobytes() for a in arrays)]], columns=INDEX.names)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1.astype(np.uint64) % np.uint64(shards)).astype(np.int64)


class LineIndex:
    """Any of the shards side by side, for probes of many keys at once."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        self.seeds, self.fingerprints, self.counts, self.keepers = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows] or [np.zeros(0, "<i8")]) for c in ARRAYS)
        seeds_before = slots_before = 0
        self.row_of = np.full(shards, -1)
        sizes = np.zeros((len(rows) + 1, 5), np.int64)
        for i, r in enumerate(rows):
            n_seeds, n = len(r["seeds"]) // 8, len(r["fingerprints"]) // 8
            self.row_of[r["shard"]] = i
            sizes[i] = seeds_before, n_seeds, slots_before, n, r["salt"]
            seeds_before, slots_before = seeds_before + n_seeds, slots_before + n
        self.sizes = sizes

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of documents of each key, 0 for keys that are not in the index, and the document that keeps it."""
        seeds_before, n_seeds, slots_before, n, salt = self.sizes[self.row_of[shard_of(h1, self.shards)]].T
        count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        there = n > 0
        if not there.any():
            return count, keeper
        h1, h2, seeds_before, n_seeds, slots_before, n, salt = (x[there] for x in (h1, h2, seeds_before, n_seeds, slots_before, n, salt))
        keys = single(h1, h2, salt)
        seed = self.seeds[seeds_before + (mixed(keys, 0) % n_seeds.astype(np.uint64)).astype(np.int64)]
        slot = slots_before + np.where(seed < 0, -seed - 1, (mixed(keys, np.maximum(seed, 0)) % n.astype(np.uint64)).astype(np.int64))
        count[there] = np.where(self.fingerprints[slot] == h2, self.counts[slot], 0)
        keeper[there] = self.keepers[slot]
        return count, keeper


def line_counts(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """h1, h2, keeper and n_docs of the keys that at least min_docs documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(keyed(text, min_chars)[2])
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            h1, h2 = halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    held = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long").distinct()
    counts = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(NOBODY)).alias("keeper"))
    return counts.where(F.col("n_docs") >= min_docs)


def kept_batch(batch: pa.RecordBatch, text: str, min_chars: int, dropped, names: tuple[str, str, str]) -> pa.RecordBatch:
    """The batch with the columns of these names: lines, lines dropped, text kept. dropped: keys and the rows they are in -> which go."""
    rows = [keyed(t, min_chars) for t in batch.column(text).to_pylist()]
    row_of = np.repeat(np.arange(len(rows)), [len(at) for _, at, _ in rows])
    go = dropped([k for _, _, keys in rows for k in keys], row_of) if len(row_of) else np.zeros(0, bool)
    n_lines, n_dropped, kept, start = [], [], [], 0
    for lines, at, _ in rows:
        gone = {i for i, g in zip(at, go[start : start + len(at)].tolist()) if g}
        start += len(at)
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone] if gone else lines).decode())
    new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])


def indexed(keys: DataFrame, shards: int) -> DataFrame:
    """A row of arrays for each shard of keys (h1, h2, n_docs, keeper)."""
    shard = F.expr(f"pmod(cast(h1 as decimal(20)) + if(h1 < 0, 18446744073709551616BD, 0BD), {shards})").cast("long")
    return keys.select(shard.alias("shard"), "h1", "h2", "n_docs", "keeper").groupBy("shard").applyInPandas(built, INDEX)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS,
    names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text"),
) -> DataFrame:
    """docs with the number of lines, of those dropped, and the text kept."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    GONE, ROW = unused(docs, "_gone"), unused(docs, "_row")
    counts = stored(line_counts(docs, min_chars, min_docs), "line-counts")
    total, held = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    least = -(-held // hot_keys) if hot_keys else held + 1  # documents of a hot key; no more than hot_keys keys have as many
    is_hot = F.col("n_docs") >= least
    n_hot = counts.where(is_hot).count()
    hot_shards = max(1, -(-n_hot // shard_keys))
    hot_rows = [r.asDict() for r in indexed(counts.where(is_hot), hot_shards).collect()]
    sent = spark.sparkContext.broadcast((hot_rows, hot_shards))
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.LongType(), T.LongType(), T.StringType()))])

    def goes(found: tuple[np.ndarray, np.ndarray], ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        return (found[0] >= min_docs) & ((found[1] != ids) | null)

    def ids_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column(name).cast(pa.int64())
        return ids.fill_null(NOBODY).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)

    def strip(batches):
        lines = LineIndex(*sent.value)
        for batch in slices(batches):
            ids, null = ids_of(batch, "doc_id")
            told = batch.column(GONE).to_pylist() if GONE in batch.schema.names else None

            def dropped(keys, row):
                out = goes(lines.probe(*halves(keys)), ids[row], null[row])
                if told:
                    out |= np.array([k in (told[r] or ()) for k, r in zip(keys, row.tolist())], bool)
                return out

            yield kept_batch(batch.drop_columns([GONE, ROW]) if told is not None else batch, "text", min_chars, dropped, names)

    if n_hot == total:  # no key is left to ask the other shards for
        return docs.mapInArrow(strip, schema)

    # Rows of one document share its answers; rows without a doc_id those of their text.
    named = docs.withColumn(ROW, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    shards = max(-(-(total - n_hot) // shard_keys), -(-docs.count() // SHARD_DOCS))

    def ask(batches):
        lines = LineIndex(*sent.value)
        for batch in slices(batches):
            rows, ids, keys = [], [], []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = set(keyed(text, min_chars)[2])
                keys += own
                rows += [row] * len(own)
                ids += [doc_id] * len(own)
            h1, h2 = halves(keys)
            open_ = pa.array(lines.probe(h1, h2)[0] == 0)
            columns = [pa.array(x).filter(open_) for x in (shard_of(h1, shards), h1, h2)] + [pa.array(rows, pa.string()).filter(open_), pa.array(ids, pa.int64()).filter(open_)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "h1", "h2", "row", "doc_id"])

    def answer(batches):
        """Each shard's arrays come before its probes."""
        shard, lines = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("shard").to_numpy()
            arrays = batch.column("seeds").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | arrays[1:] | arrays[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                if arrays[a]:
                    shard, lines = at[a], LineIndex(part.select(INDEX.names).to_pylist(), shards)
                elif at[a] == shard:
                    ids, null = ids_of(part, "doc_id")
                    both = np.stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()], axis=1)
                    go = goes(lines.probe(*both.T), ids, null)
                    if go.any():
                        keys = [k.astype("<i8").tobytes() for k in both[go]]
                        yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(go)), pa.array(keys, pa.binary())], ["row", "key"])

    probes = named.select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(ask, "shard long, h1 long, h2 long, row string, doc_id long")
    cold = indexed(counts.where(~is_hot), shards)
    both = cold.unionByName(probes.distinct(), allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("seeds").isNull())
    gone = both.mapInArrow(answer, "row string, key binary")
    gone = gone.groupBy(F.col("row").alias(ROW)).agg(F.collect_set("key").alias(GONE))  # no more than a document's lines
    return named.join(gone, ROW, "left").select(*docs.columns, ROW, GONE).mapInArrow(strip, schema)


def op5_line_dedup(spark, sf_dir):
    from .shared import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), counted AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), decided AS (
  SELECT r, doc_id, i, line, (c.k IS NOT NULL AND doc_id <> keeper) AS gone FROM keyed LEFT JOIN counted c USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM decided GROUP BY r
"""
