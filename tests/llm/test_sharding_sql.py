"""The sharding query against its SQL; rows without an id."""

import sys
from pathlib import Path

from stratapoint.llm import sharding

sys.path.insert(0, str(Path(__file__).parents[1]))

from compare import same_rows  # noqa: E402


def test_the_query_equals_its_sql(spark, sf):
    same_rows(sharding.op7_sharding(spark, sf), sharding.OP7_SQL, sf)


def test_rows_without_an_id_fill_many_buckets(spark):
    rows = [(None, "same", "hot", "x")] * 3000 + [(i, "é" * 40_000 if i < 3 else None, None, "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _rank string")
    out = sharding.interleave(docs, bucket_rows=64).collect()
    counts = [sum(r.shard == s for r in out) for s in range(24)]
    assert len(out) == 3500 and max(counts) - min(counts) <= 1
    hot = [sum(r.shard == s and r.source == "hot" for r in out) for s in range(24)]
    assert max(hot) - min(hot) <= 2
    assert {r.size for r in out if r.doc_id in (0, 1, 2)} == {80_008}
