"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words (runs of letters and digits). The Karp-Rabin hashes of
all runs of `tile` words of the items are the seeds; each document's runs are joined with them, and the words of
both are compared, which leaves the few pairs that share a seed. For these the tiling is greedy: the longest match of still
unmarked words is marked in both texts, again and again, until no match of `tile` words is left. Shared
seeds at neighbouring places on a diagonal are one match. The marked share of the item is its coverage, whatever the order of the tiles; a document that
covers at least `threshold` of an item is contaminated.

A benchmark of at most `sent_bytes` of text is sent to all tasks, and documents are tiled where they are. A larger one stays a
table: its seeds set the bits of a filter of bounded size (FILTER_BITS), which is sent instead; the runs that pass it are joined with the seed table by
their words, and each text is tiled from its joined places. Equal texts are then looked at once. Both ways give the same rows.

Null texts and items have no words. Items of fewer than `tile` words have no seed and match nothing. Repeated rows are each
reported, repeated items by their smallest id, items without an id by null. Empty tables give no contamination. All columns of the input stay,
but for those named like a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import slices, stored, unused

TILE = 5
THRESHOLD = 0.6
#: UTF-8 bytes of the items that are sent to all tasks, at most.
SENT_BYTES = 16 << 20
#: Bits of the filter that stands for the seeds of a larger benchmark, at most: 64 MB.
FILTER_BITS = 29
WORDS = re.compile(r"[^\W_]+").findall
BASE = 0x9E3779B97F4A7C15


def runs(ids: np.ndarray, tile: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of `tile` ids, in arithmetic modulo 2^64."""
    n = len(ids) - tile + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(tile if n > 0 else 0):
        h = h * np.uint64(BASE) + (ids[k : k + n] + 1).astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def tiles(at: np.ndarray, item_at: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, words) of each tile, from all places where runs of `tile` words are equal."""
    out = []
    order = np.lexsort((at, at - item_at))
    at, item_at = at[order], item_at[order]
    while len(at):
        start = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(item_at) != 1))))
        length = np.diff(np.concatenate((start, [len(at)]))) + tile - 1
        best = np.lexsort((item_at[start], at[start], -length))[0]
        a, i, n = int(at[start[best]]), int(item_at[start[best]]), int(length[best])
        out.append((a, i, n))
        free = ((at + tile <= a) | (at >= a + n)) & ((item_at + tile <= i) | (item_at >= i + n))
        at, item_at = at[free], item_at[free]
    return out


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


class Benchmark:
    """Items, with their seeds sorted."""

    def __init__(self, items: list[tuple[int | None, str]], tile: int):
        self.tile, self.vocabulary = tile, {}
        hashes, owner, place, self.ids, self.sizes, all_words = [], [], [], [], [], []
        for item_id, text in items:
            words = words_of(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            h = runs(ids, tile)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.sizes.append(len(words))
            all_words.append(ids)
        hashes, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner, place))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.words = np.concatenate(all_words) if all_words else np.zeros(0, np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    def overlaps(self, text: str | None) -> list[tuple[int | None, float, int]]:
        """item_id, coverage and number of tiles of each item that shares a seed with the text."""
        known = self.vocabulary.get
        ids = np.array([known(w, -1) for w in words_of(text)], np.int64)
        if len(ids) < self.tile or not len(self.hashes):
            return []
        h = runs(ids, self.tile)
        whole = np.convolve(ids < 0, np.ones(self.tile, np.int64), "valid") == 0
        at = np.flatnonzero(whole)
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return []
        seed = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at, owner, place = np.repeat(at, n), self.owner[seed], self.place[seed]
        begin = self.begin[owner] + place
        same = np.all([ids[at + k] == self.words[begin + k] for k in range(self.tile)], axis=0)  # hashes may collide
        at, owner, place = at[same], owner[same], place[same]
        out = []
        for item in np.unique(owner).tolist():
            own = owner == item
            found = tiles(at[own], place[own], self.tile)
            out.append((self.ids[item], sum(k for _, _, k in found) / self.sizes[item], len(found)))
        return out


OVERLAPS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())]))


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))


def overlaps(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, out: str = "overlaps", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with the items that each text shares words with, and their coverage."""
    docs = docs.drop(out)
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).select("item_id", "text")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > sent_bytes:
        return joined_overlaps(docs, stored(items, "benchmark-items"), tile, out)
    sent = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])  # sent_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(sorted(sent.value, key=lambda r: (r[0] is None, r[0] or 0, r[1])), tile)
        for batch in slices(batches):
            found = [[{"item_id": i, "coverage": c, "tiles": n} for i, c, n in block.overlaps(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, KIND)], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, OVERLAPS)]))


def word_runs(text: str | None, tile: int) -> tuple[list[str], np.ndarray]:
    """The words of a text and the Karp-Rabin hashes of their runs, from 64-bit hashes of the words."""
    words = words_of(text)
    return words, runs(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), tile)


def bits_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a hash sets."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def joined_overlaps(docs: DataFrame, items: DataFrame, tile: int, out: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """overlaps by a join of the runs that pass a filter with the seed table."""
    spark = docs.sparkSession

    def seeds(batches):
        for batch in slices(batches):
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words, h = word_runs(text, tile)
                n = len(h)
                name = hashlib.md5(text.encode()).hexdigest()
                rows = [[" ".join(words[i : i + tile]) for i in range(n)], h.view(np.int64), [item_id] * n, [name] * n, [len(words)] * n, np.arange(n)]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds)], ["run", "hash", "item_id", "item", "words", "place"])

    table = stored(items.mapInArrow(seeds, "run string, hash long, item_id long, item string, words int, place int"), "benchmark-seeds")
    bits = max(16, min(filter_bits, int(16 * table.count()).bit_length()))
    chunk = 1 << 16

    def chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(chunk, bool)
        on[pdf["bit"].to_numpy() % chunk] = True
        return pd.DataFrame({"chunk": [int(pdf["bit"].iloc[0]) // chunk], "data": [np.packbits(on, bitorder="little").tobytes()]})

    low = F.lit((1 << bits) - 1)
    both = F.explode(F.array(F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", 32).bitwiseAND(low)))
    set_bits = table.select(both.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / chunk)).applyInPandas(chunks, "chunk long, data binary")
    data = bytearray(1 << (bits - 3))
    for r in set_bits.toLocalIterator():  # no more than the filter
        data[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = r.data
    sent = spark.sparkContext.broadcast(bytes(data))

    key = F.md5(F.col("text").cast("binary"))
    own = unused(docs, "_text_key")

    def passing(batches):
        on = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, h = word_runs(text, tile)
                one, other = bits_of(h, bits)
                at = np.flatnonzero((on[one >> 3] >> (one & 7).astype(np.uint8)) & (on[other >> 3] >> (other & 7).astype(np.uint8)) & 1)
                if len(at):
                    columns = [pa.array([name] * len(at)), pa.array([" ".join(words[i : i + tile]) for i in at.tolist()]), pa.array(at, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["text_key", "run", "at"])

    def tiled(pdf: pd.DataFrame) -> pd.DataFrame:
        found = tiles(pdf["at"].to_numpy(), pdf["place"].to_numpy(), tile)
        first = pdf.iloc[0]
        return pd.DataFrame({"text_key": [first["text_key"]], "item_id": pd.array([first["item_id"]], "Int64"), "coverage": [sum(n for _, _, n in found) / first["words"]], "tiles": [len(found)]})

    texts = docs.where("text IS NOT NULL").select(key.alias("text_key"), "text")
    hits = texts.mapInArrow(passing, "text_key string, run string, at int").distinct()
    places = hits.join(table.select("run", "item_id", "item", "words", "place"), "run")
    found = places.groupBy("text_key", "item").applyInPandas(tiled, "text_key string, item_id long, coverage double, tiles int")  # a text's places in one item
    each = F.struct("item_id", "coverage", "tiles")
    lists = found.groupBy(F.col("text_key").alias(own)).agg(F.collect_list(each).alias(out))  # the items that one text shares words with
    joined = docs.withColumn(own, key).join(lists, own, "left")
    return joined.select(*docs.columns, F.coalesce(out, F.expr("array()").cast(OVERLAPS)).alias(out))


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `contaminated`, the items covered from the threshold on (`items`), and the most covered item."""
    docs = docs.drop("_overlaps", "contaminated", "items", "item_id", "coverage", "tiles")
    found = overlaps(docs, benchmark, tile, out="_overlaps")
    best = F.expr("array_max(transform(_overlaps, x -> struct(x.coverage as coverage, -x.item_id as item, x.tiles as tiles)))")  # of equal ones that without an id last
    found = found.withColumn("_best", best)
    return found.select(
        *docs.columns,
        F.coalesce(F.col("_best.coverage") >= threshold, F.lit(False)).alias("contaminated"),
        F.expr(f"array_sort(transform(filter(_overlaps, x -> x.coverage >= {threshold}D), x -> x.item_id))").alias("items"),
        F.expr("-_best.item").alias("item_id"),
        F.coalesce("_best.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("_best.tiles", F.lit(0)).alias("tiles"),
    )


def op6_decontamination(spark, sf_dir):
    """The contaminated documents, each with the items found in it."""
    from .shared import table

    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.where("contaminated").select("doc_id", "contaminated", "item_id", "coverage", "tiles", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("item_ids"))
