"""Language ID: multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all learning rows. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a sample of about `train_rows` distinct rows,
drawn by a hash of doc_id and text, as many for each language as there are; most weights end at zero. A
temperature fitted on the part of the sample that training left out calibrates the scores.

Predictions see nothing but the text, all of it. A text that is null or has no letter is `und` with
score 0. With no row to learn from every prediction is `und`. Rows with a null language teach
nothing. Repeated rows are each predicted. All columns of the input stay, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import fold, slices

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
TRAIN_ROWS = 6_000
FOLDS, HELD_OUT = 3, 1


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's lower-cased character n-grams, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, h = [], np.zeros(len(c), np.uint64)
    for n in ORDERS:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=SIZE) if found else np.zeros(SIZE, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    return x / (np.sqrt(x @ x) or 1.0)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


@dataclass
class LanguageModel:
    """Languages, weights by bucket and language, a bias for each, the weight of each bucket and a temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        at, counts = ngrams(text)
        z = (weighed(at, counts, self.idf) @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        p = self.scores(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def ftrl(rows: list, classes: int, idf: np.ndarray, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002):
    """Weights and biases after a few passes over rows of (buckets, counts, class)."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    rng = np.random.default_rng(7)

    def solved(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, counts, label = rows[i]
            x = np.append(weighed(at, counts, idf), 1.0)
            at = np.append(at, SIZE)
            w = solved(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solved(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def fitted(rows: list, languages: list[str], idf: np.ndarray) -> LanguageModel:
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    weights, bias = ftrl([r for i, r in enumerate(rows) if i % 5] or rows, len(languages), idf)
    model = LanguageModel(languages, weights, bias, idf, 1.0)
    logits = np.array([weighed(at, counts, idf) @ weights[at] + bias for at, counts, _ in held])
    labels = np.array([c for _, _, c in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def learn(docs: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from the rows of docs (doc_id, text, lang) where `allowed` holds."""
    own = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    per_language = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # as many rows as languages
    languages = sorted(per_language)
    if not languages:
        return LanguageModel([], np.zeros((SIZE, 0)), np.zeros(0), np.ones(SIZE), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    total = sum(per_language.values())
    counted = own.select("text").mapInArrow(frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # SIZE rows at most
    df = np.zeros(SIZE)
    df[counted["bucket"].to_numpy(int)] = counted["df"].to_numpy(float)
    idf = np.log((1 + total) / (1 + df)) + 1

    share = F.lit(0.0)
    for name, n in per_language.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, train_rows / len(languages) / n))).otherwise(share)
    key = F.xxhash64("doc_id", "text", "lang", F.lit(17))
    drawn = own.select(key.alias("key"), "lang", "text").where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))

    def counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the counts of a text's n-grams, SIZE numbers at most, go to the task that fits."""
        for batch in slices(batches):
            found = [ngrams(t) for t in batch.column("text").to_pylist()]
            packed = [pa.array([x.astype("<i4").tobytes() for x in c], pa.binary()) for c in zip(*found)] if found else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), *packed], ["key", "lang", "at", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in slices(batches):
            rows += zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "at", "counts")))
        rows.sort()
        model = fitted([(*(np.frombuffer(x, "<i4").astype(np.int64) for x in (at, counts)), languages.index(lang)) for _, lang, at, counts in rows], languages, idf) if rows else None
        if model:
            at = np.flatnonzero(np.any(model.weights != 0, axis=1))
            packed = [at.astype("<i8"), model.weights[at], model.bias, np.array([model.temperature])]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["at", "weights", "bias", "temperature"])

    sample = drawn.mapInArrow(counted_rows, "key long, lang string, at binary, counts binary").dropDuplicates(["key"]).coalesce(1)  # a bounded sample: one task fits it
    found = sample.mapInArrow(fit, "at binary, weights binary, bias binary, temperature binary").first()
    if found is None:  # the draw can leave nothing of very few rows
        return learn(docs, allowed, 4 * train_rows)
    at, weights, bias, temperature = (np.frombuffer(x, kind) for x, kind in zip(found, ("<i8", "f8", "f8", "f8")))
    dense = np.zeros((SIZE, len(languages)))
    dense[at] = weights.reshape(len(at), len(languages))
    return LanguageModel(languages, dense, bias, idf, float(temperature[0]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with a language and its score."""
    docs = docs.drop(language, score)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x languages numbers

    def run(batches):
        for batch in slices(batches):
            found = [sent.value.predict(t) for t in batch.column(text).to_pylist()]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, language, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]))


def op3_language_id(spark, sf_dir):
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    held_out = fold(FOLDS) == HELD_OUT
    model = learn(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, score="score").drop("text")
