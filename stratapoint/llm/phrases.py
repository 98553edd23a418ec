"""Phrase collocation mining: contiguous phrases that keep their words together, per language.

Phrases of one word, then of two and so on up to `max_words` become rows (language, phrase, occurrences) and are hash-aggregated per
language. A phrase can reach `min_count` only if both its parts of one word less do, so each pass makes rows only of phrases whose parts
stand in a filter of those that did. The filter has at most 2^FILTER_BITS bits at any size of the corpus; what it lets pass by
mistake falls at the exact count. Every candidate's parts are then counted as well, and joined for each cut; scores are whole numbers of Decimal
division; an anti-join with the extensions by one word drops phrases that live inside a longer one (a longer one still has no
more occurrences than the extension between, so one word is enough); each language is ranked in two windows, the first over parts of it.

Texts are lower-cased in A-Z, split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. A null text is empty, a null
language `und`. Repeated rows count again. An empty table gives no phrases. Columns other than text and lang are not read.
A piece, not a text, is what a task must hold at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .shared import forget, portions, stored

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A longer phrase with so many hundredths of a phrase's occurrences stands for it.
COVER = 80
SCALE = 2_000_000
#: Bits of the filter of phrases that reached the count: the least, the most, and for each phrase.
LEAST_BITS, FILTER_BITS, BITS_A_KEY = 20, 29, 16
SEGMENT_BITS = 19
#: Bytes of text that are counted at once, and parts of a language that are ranked apart first.
PORTION, RANKED_APART = 8_000_000, 64
UNDETERMINED = "und"

_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
_BREAK = b"\n"
#: A-Z to a-z, tabs to spaces, all that ends a piece to a line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
GRAMS = "lang string, phrase string, f long"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEPS[1]
    return h ^ (h >> np.uint64(29))


def hashes(words: np.ndarray, starts: np.ndarray, n: int, lang: int) -> np.ndarray:
    """A hash of the n words from each start on, and of the language; words: the hash of each word in order."""
    h = mixed(words[starts] ^ np.uint64(lang))
    for k in range(1, n):
        h = mixed(h * _STEPS[0] + words[starts + k])
    return h


def bits_at(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (h >> shift).astype(np.int64), ((h * _STEPS[0]) >> shift).astype(np.int64)


def language_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def chunks(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that end where a piece does."""
    at = 0
    while len(text) - at > size:
        end = text.find(_BREAK, at + size)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def counted(text: bytes, n: int, lang: str, known: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """The phrases of n words in plain pieces, and how often each occurs."""
    tokens = text.replace(_BREAK, b" \n ").split(b" ")
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[b""], numbers[_BREAK]  # noqa: B018  the first two numbers: no word, the end of a piece
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    ids, words = ids[ids > 0], list(numbers)
    inside = ids > 1
    starts = np.flatnonzero(inside)
    for k in range(1, n):
        starts = starts[starts + k < len(ids)]
        starts = starts[inside[starts + k]]
    if known is not None and len(starts):
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[ids]
        bits, seed = len(known).bit_length() + 2, language_hash(lang)
        h = hashes(own, np.arange(len(ids) - n + 2), n - 1, seed)
        a, b = bits_at(h, bits)
        passes = ((known[a >> 3] >> (a & 7)) & (known[b >> 3] >> (b & 7)) & 1).astype(bool)
        starts = starts[passes[starts] & passes[starts + 1]]
    key = ids[starts]
    for k in range(1, n):
        key = pd.factorize(key)[0] * len(words) + ids[starts + k]
    codes, distinct = pd.factorize(key)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = starts[::-1]
    columns = [[words[i] for i in ids[first + k].tolist()] for k in range(n)]
    return columns[0] if n == 1 else list(map(b" ".join, zip(*columns))), np.bincount(codes, minlength=len(distinct))


def phrase_rows(docs: DataFrame, n: int, known=None) -> DataFrame:
    """Rows (lang, phrase, f) of phrases of n words, counted within portions of text; known: the broadcast filter of those of n - 1 words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.frombuffer(known.value, np.uint8) if known is not None else None
        for batch in portions(batches, "text", 1 << 20, PORTION):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    by_lang.setdefault(UNDETERMINED if lang is None else lang, []).append(text.encode().translate(_PLAIN))
            for lang, texts in by_lang.items():
                for part in chunks(_BREAK.join(texts), PORTION):
                    phrases, f = counted(part, n, lang, allowed)
                    for i in range(0, len(phrases), 100_000):
                        some = pa.array(phrases[i : i + 100_000], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(f[i : i + 100_000])], schema=schema)

    return docs.select("lang", "text").mapInArrow(run, GRAMS)


def filter_of(grams: DataFrame, n: int) -> bytes:
    """The bits of phrases of n words, made segment by segment where Spark has dealt their places."""
    keys = grams.count()
    bits = min(FILTER_BITS, max(LEAST_BITS, (BITS_A_KEY * keys).bit_length()))
    segments = 1 << (bits - SEGMENT_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            own = np.array([xxhash.xxh3_64_intdigest(w.encode()) for p in words for w in p], np.uint64)
            langs = batch.column("lang").to_pylist()
            seed = {x: language_hash(x) for x in set(langs)}
            h = np.zeros(0, np.uint64)
            if langs:
                h = mixed(own[::n] ^ np.array([seed[x] for x in langs], np.uint64))
                for k in range(1, n):
                    h = mixed(h * _STEPS[0] + own[k::n])
            at = np.unique(np.concatenate(bits_at(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> SEGMENT_BITS).astype(np.int32)), pa.array((at & ((1 << SEGMENT_BITS) - 1)).astype(np.int32))], ["segment", "at"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at = batch.column("segment").to_numpy(), batch.column("at").to_numpy()
            for s in np.unique(segment).tolist():
                own.setdefault(s, np.zeros(1 << SEGMENT_BITS, bool))[at[segment == s]] = True
        for s, on in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()])], ["segment", "bits"])

    found = grams.select("lang", "phrase").mapInArrow(places, "segment int, at int").repartition(min(64, segments), "segment")
    out = np.zeros((segments, 1 << (SEGMENT_BITS - 3)), np.uint8)
    for s, part in found.mapInArrow(filled, "segment int, bits binary").collect():  # 2^FILTER_BITS bits at most
        out[s] = np.frombuffer(part, np.uint8)
    return out.tobytes()


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` phrases of each language."""
    sc = docs.sparkSession.sparkContext
    words = stored(phrase_rows(docs, 1).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrases-1")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, known = [stored(words.where(F.col("f") >= min_count), "phrases-frequent")], None
    totals = stored(totals, "phrases-totals")
    forget(words)
    for n in range(2, max_words + 1):
        known = sc.broadcast(filter_of(levels[-1], n - 1))
        rows = phrase_rows(docs, n, known).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        levels.append(stored(rows.where(F.col("f") >= min_count), f"phrases-{n}"))
        known.unpersist()
    found = [level.withColumn("words", F.lit(n)) for n, level in enumerate(levels, 1)]
    counts, candidates = levels[0], found[1]
    for level in levels[1:]:
        counts = counts.union(level)
    for level in found[2:]:
        candidates = candidates.union(level)

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(f as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = cuts.select("lang", "phrase", "f", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.min("cut").alias("cut"))

    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)"))
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))
    longer = longer.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("in_phrase"), F.col("f_longer").cast("decimal(19,0)") * 100)
    covered = longer.toDF("in_lang", "in_phrase", "hundredths")
    covers = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")) & (F.col("hundredths") >= F.col("a").cast("decimal(19,0)") * cover)
    kept = best.join(covered, covers, "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = (F.desc("score"), F.desc("a"), "phrase")
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = some.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return some.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    from .shared import table

    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  {" UNION ALL ".join(f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM words)" for n in range(1, MAX_WORDS + 1))}),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {MIN_COUNT}),
cuts AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.words = k JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.words = c.words - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest(list_distinct(flatten([[array_to_string(w[i:i + m - 1], ' ') for i in range(1, words - m + 2)] for m in range(2, words)]))) AS phrase FROM candidates WHERE words > 2)
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100::HUGEINT * g.a < {COVER}::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
