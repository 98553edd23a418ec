"""The graph of neighbours in buckets: what its steps send each other, held against lists made by hand."""

import numpy as np
import pandas as pd

from stratapoint.llm import neighbours, shared


def test_best_rows_equal_a_sort_by_hand():
    rng = np.random.default_rng(5)
    group, ids = rng.integers(0, 40, 5_000), rng.integers(-30, 30, 5_000)
    scores = (np.abs(ids) * 7 % 31 - 15 + group / 64 + ids / 1024).astype("f4")  # one for each pair, some below zero
    known = rng.random(5_000) < 0.3
    keep = neighbours.best_rows(group, ids, scores, 8, known)
    got = [(int(group[i]), int(ids[i]), bool(known[i])) for i in keep]
    want = []
    for g in range(40):
        own = {int(i): float(s) for i, s in zip(ids[group == g], scores[group == g])}
        best = sorted(own, key=lambda i: -own[i])[:8]
        want += [(g, i, bool(known[(group == g) & (ids == i)].any())) for i in best]
    assert got == want


def test_buckets_send_one_row_to_each_other_and_lose_no_member(spark):
    """5,000 nodes with 8 neighbours each are 40,000 and more pairs, but no more rows than pairs of buckets."""
    n, k, buckets, reverse = 5_000, 8, 4, 3
    rng = np.random.default_rng(6)
    v = rng.standard_normal((n, 5)).astype("f2")
    nodes = spark.createDataFrame([(i * 7 - 900, v[i].tobytes()) for i in range(n)], "node long, v binary")
    lists = {i * 7 - 900: [int(j) * 7 - 900 for j in rng.choice(n - 1, k, replace=False) if j != i] for i in range(n)}
    flat = [(a, b, rank) for a, own in lists.items() for rank, b in enumerate(own)]
    node, ids, scores = (np.array(c, t) for c, t in zip(zip(*flat), ("i8", "i8", "f4")))
    better = spark.createDataFrame(pd.DataFrame(neighbours.rows_for(node % buckets, -1, node=node, ids=ids, scores=-scores)), neighbours.BETTER)
    graph = neighbours.merged(neighbours.packed(nodes, k, buckets), better, k)
    rows = neighbours.gathered(graph, k, reverse, buckets).toPandas()
    assert len(rows) <= buckets * buckets
    back: dict[int, set[int]] = {}
    for a, b, _ in flat:
        back.setdefault(b, set()).add(a)
    names = {v[i].tobytes(): i * 7 - 900 for i in range(n)}
    seen = 0
    for _, own in rows.groupby("to"):
        centers, count, index, fresh, members, x = neighbours.around(own, 5)
        assert fresh.all()
        for c, part in zip(centers.tolist(), np.split(index, np.cumsum(count)[:-1])):
            got = [int(members[p]) for p in part]
            assert [names[x[p].astype("f2").tobytes()] for p in part] == got and len(set(got)) == len(got)
            forward, others = set(lists[c]), back.get(c, set())
            assert forward <= set(got) <= forward | others
            assert min(reverse, len(others)) - len(forward & others) <= len(set(got) - forward) <= reverse
            seen += 1
    assert seen == n


def test_a_bucketed_table_is_not_shuffled_again(spark, capsys):
    links = shared.bucketed(spark.range(1_000).selectExpr("id % 8 AS to", "id"), "to", 8, "test-links")
    asked = spark.range(1_000).selectExpr("id % 8 AS to", "id AS q")
    both = asked.groupBy("to").cogroup(links.groupBy("to")).applyInPandas(lambda a, b: pd.DataFrame({"to": a["to"].iloc[:1], "n": [len(a) * len(b)]}), "to long, n long")
    both.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    assert sorted((r.to, r.n) for r in both.collect()) == [(i, 125 * 125) for i in range(8)]
