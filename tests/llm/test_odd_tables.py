"""Every query of the subpackage and every stage of the pipeline over tables that are empty or odd."""

import pytest
from pyspark.sql import functions as F

from stratapoint.llm import registry

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
LONG = "a long text of many words " * 30_000
PASSAGE = " ".join(f"passage{i}" for i in range(40))
SHARED = "this very line stands in many of the documents here"
ODD = {
    "documents": [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", None, 1), (4, "the same text twice", None, "a", 4), (4, "the same text twice", None, "a", 4),
        (None, "no id at all", "en", "a", 5), (None, None, None, None, None), (5, "\n\n \t\n", "en", "a", 6), (6, "é" * 50, "fr", "b", 50), (7, f"before {PASSAGE} after", "en", "b", 9),
        *[(10 + i, f"{SHARED}\nown words number {i} of these few", "en", "b", 9) for i in range(8)], (30, "a" * 100_000, "en", "b", 9),
    ],
    "labels": [(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1), (4, 0, 1), (10, None, None), (None, 1, 0), (11, 1, 0), (12, 0, 0), (999, 1, 0)],
    "benchmark": [(1, PASSAGE), (1, PASSAGE), (2, None), (None, "an item without a name but with words"), (3, "")],
    "embeddings": [(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [2.0, 1.0], None), (None, [1.0, 1.0], 0)],
}


@pytest.fixture(scope="module", params=["empty", "odd"])
def tables(spark, request, tmp_path_factory):
    """A folder of tables, with a column more than is known in each."""
    folder = tmp_path_factory.mktemp(request.param)
    for name, schema in SCHEMAS.items():
        rows = ODD[name] if request.param == "odd" else []
        spark.createDataFrame(rows, schema).withColumn("Score", F.lit("theirs")).coalesce(2).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), len(ODD["documents"]) if request.param == "odd" else 0


#: Queries that return a row for each document.
BY_ROW = ["op1_quality", "op2_simhash", "op3_language_id", "op4_byte_bpe", "op5_line_dedup", "op7_sharding", "op10_pii", "op13_lm_scoring"]


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_for_each_document(spark, tables, name):
    folder, n = tables
    assert len(registry.QUERIES[name](spark, folder).collect()) == n


def test_other_queries(spark, tables):
    folder, n = tables
    found = registry.QUERIES["op6_decontamination"](spark, folder).collect()
    assert [r.doc_id for r in found] == ([7] if n else [])
    near = registry.QUERIES["op8_neighbours"](spark, folder).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == ([(0, 1, 20), (0, 2, 5), (20, 1, 0), (20, 2, 5)] if n else [])
    assert not registry.QUERIES["op12_clusters"](spark, folder).collect()  # no vector has 64 components
    assert [r.lang for r in registry.QUERIES["op11_phrases"](spark, folder).collect()].count("en") == (6 if n else 0)  # four words in a circle of six; shorter ones live inside them
    places = registry.QUERIES["op9_training_order"](spark, folder).collect()
    assert {r.doc_id for r in places} == ({r[0] for r in ODD["documents"]} if n else set())


def test_every_stage(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, n = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:  # each on all rows, whatever the stages before it would keep
        out = stage(spark, docs, folder)
        assert name == "byte_bpe" or out.columns == docs.columns
        rows = out.collect()
        assert len(rows) <= n
        if name == "line_dedup":
            assert len(rows) == n and sum(SHARED in (r.text or "") for r in rows) == (1 if n else 0)
        if name == "near_dedup" and n:
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 6, 7, *range(10, 18), 30]  # 2 and 5 have no words, as 1
            assert sum(r.doc_id is None for r in rows) == 2
        if name == "decontamination":
            assert len(rows) == n - bool(n)
        if name == "byte_bpe":
            assert len(rows) == n and all(r.round_trip for r in rows)
    assert pipeline.run(spark, folder).count() <= n
