"""Quality classifier: a sparse ensemble of rules taken from trees.

Every text is reduced to a few statistics. A random forest is grown on those of the labelled rows;
each path from a root to a node is a rule, a conjunction of thresholds; a logistic regression with
a lasso penalty over all rules keeps few of them. The kept rules become one Spark column expression
over the statistics. Growing and fitting use all labelled rows of the learning folds, as Spark jobs.

A null text has the statistics of the empty text; both get a score. Labels of unknown documents and
null labels teach nothing. With labels of one kind only the score is their share. Repeated rows are each
scored. An empty table gives an empty result. All columns of the input stay, but for those named like a statistic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import fold, slices, stored

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
TREES, DEPTH, PENALTY = 24, 3, 0.002

STATISTICS = [
    "stat_chars", "stat_words", "stat_lines", "stat_word_length", "stat_longest_word", "stat_distinct_words", "stat_distinct_lines",
    "stat_top_word", "stat_upper", "stat_lower", "stat_digit", "stat_space", "stat_stop", "stat_bang", "stat_bar", "stat_symbol", "stat_other",
    "stat_symbol_words", "stat_upper_words", "stat_short_words", "stat_words_per_stop",
]

#: Byte classes, in the order of the shares stat_upper to stat_other.
CLASSES = np.full(256, 8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\v\f", b".,;:", b"!?", b"|", b"#$%&*@^~_=+<>/\\{}[]`")):
    CLASSES[list(_chars)] = _k
CLASSES[128:] = 1  # parts of letters, nearly always


def statistics_of(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x]
    n, w = max(1, len(data)), max(1, len(words))
    classes = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=9) if data else np.zeros(9)
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(len(text or "")), float(len(words)), float(len(lines)), float(lengths.mean()) if words else 0.0, float(lengths.max(initial=0)),
        len(counts) / w, len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / w,
        *(classes / n).tolist(),
        sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:!?\"')") / w,
        sum(1 for x in words if len(x) > 1 and x.isupper()) / w,
        float((lengths <= 3).sum()) / w, w / max(1.0, float(classes[4])),
    ]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns STATISTICS."""
    docs = docs.drop(*STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([statistics_of(t) for t in batch.column(text).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in rows.T)], [*batch.schema.names, *STATISTICS])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in STATISTICS)]))


#: A condition: statistic, "<=" or ">", threshold.
Condition = tuple[str, str, float]


@dataclass
class RuleEnsemble:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            z = z + holds(conditions) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(conditions: tuple[Condition, ...]) -> Column:
    all_hold = F.lit(True)
    for name, sign, threshold in conditions:
        all_hold = all_hold & (F.col(name) <= threshold if sign == "<=" else F.col(name) > threshold)
    return F.when(all_hold, 1.0).otherwise(0.0)


def paths(node, above: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """The conditions that lead to each node below this one of a fitted Spark tree."""
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
    for child, sign in ((node.leftChild(), "<="), (node.rightChild(), ">")):
        here = (*above, (name, sign, threshold))
        yield here
        yield from paths(child, here)


def learn(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """labelled: the columns STATISTICS and label, 0.0 or 1.0."""
    rows = stored(labelled.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "label", *STATISTICS), "quality-rows")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        share = (good + 0.5) / (n + 1)
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", seed=11, minInstancesPerNode=5).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"))})
    if not rules:
        return RuleEnsemble([], float(np.log(good / (n - good))))
    held = rows.select("label", array_to_vector(F.array(*map(holds, rules))).alias("features"))
    fit = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(stored(held, "quality-rules"))
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, fit.coefficients.toArray()) if w], float(fit.intercept))


def op1_quality(spark, sf_dir):
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "text")
    known = stored(statistics(docs).drop("text"), "quality-statistics")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    model = learn(known.where(~F.col("held_out")).join(labels, "doc_id"))
    out = known.select("doc_id", "held_out", model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
