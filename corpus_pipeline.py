"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of docs; the last returns the token ids of each remaining document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapoint.llm import bpe, decontaminate, language, lines, shared, similar

#: Documents whose language is known with less certainty go, and with them those without letters.
MIN_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages of docs; learns from the same folds as the language query."""
    model = language.learn(docs, shared.fold(language.FOLDS) != language.HELD_OUT)
    name, score = shared.unused(docs, "lang_pred"), shared.unused(docs, "lang_score")
    found = language.identify(docs, model, language=name, score=score)
    return found.where((F.col(name) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document keeps; n_chars follows the text."""
    names = tuple(shared.unused(docs, n) for n in ("n_lines", "n_dropped", "kept_text"))
    out = lines.dedup_lines(docs, names=names).withColumn("text", F.col(names[2]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by a 5-word Jaccard similarity of 0.8 or more: that of the smallest
    doc_id, then of the smallest hash of its text. The SimHash operator finds the first links, an exact join the rest. Rows without a doc_id cannot be named and stay."""
    key = shared.unused(docs, "text_key")
    named = docs.withColumn(key, similar.text_key())
    groups = similar.similar_groups(docs)
    rows = named.where("doc_id IS NOT NULL").groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("_rows"))
    rows = rows.join(groups.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    keep = rows.groupBy("component").agg(F.min(F.struct("doc_id", key, "_rows")).alias("_kept")).select("_kept.*")
    keep = shared.stored(keep, "near-duplicates")
    kept = named.join(keep.where("_rows = 1"), ["doc_id", key], "left_semi").select(*docs.columns)
    repeated = keep.where("_rows > 1")
    if not repeated.isEmpty():
        again = named.join(repeated, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.union(again.select(*docs.columns))
    return kept.union(docs.where("doc_id IS NULL"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that cover no benchmark item."""
    name = shared.unused(docs, "overlaps")
    found = decontaminate.overlaps(docs, shared.table(spark, sf_dir, "benchmark"), out=name)
    covers = F.exists(name, lambda x: x["coverage"] >= decontaminate.THRESHOLD)
    return found.where(~covers).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids as little-endian numbers of 32 bits, their number, and whether they decode to the text."""
    path, pattern = bpe.public_vocabulary()
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded="decoded")
    return out.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", no_benchmark),
    ("byte_bpe", tokens),
]

#: Models, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return docs
