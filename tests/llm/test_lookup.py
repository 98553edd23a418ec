"""The LM's look-up of common words, and its word counts."""

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapoint.llm import mixing


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_common_words_have_their_numbers_and_no_other_has_one(n):
    words = [f"w{i}".encode() for i in range(n)]
    lookup = pickle.loads(pickle.dumps(mixing.Lookup(words)))
    asked = [f"w{i}".encode() for i in np.random.default_rng(3).integers(0, 2 * n + 9, 20_000)] + ["é".encode(), b"w"]
    numbers = {w: i for i, w in enumerate(words, mixing.ESCAPE + 1)}
    assert lookup.find(asked).tolist() == [numbers.get(w, mixing.ESCAPE) for w in asked]
    assert lookup.find([]).tolist() == []


def test_words_that_share_an_address_are_told_apart():
    """All keys begin at one address, as the worst hashes would have it."""
    lookup = mixing.Lookup([b"%d" % i for i in range(30)])
    size = len(lookup.table)
    alike = [w for w in (b"%d" % i for i in range(20_000)) if hash(w) & (size - 1) == 5][:40]
    assert len(alike) == 40
    lookup = mixing.Lookup(alike[:30])
    assert len(lookup.table) == size
    assert lookup.find(alike).tolist() == [*range(2, 32), *[mixing.ESCAPE] * 10]


def test_a_group_is_read_as_its_texts_are():
    words = [b"b", b"a", b"c"]
    texts = ["A x b", None, "  ", "C\x0bc\x1cc É", "x a"]
    (group,) = mixing.stretches(texts)
    symbols, contexts, sizes, rare = mixing.Reader(mixing.Lookup(words)).read(group)
    assert symbols.tolist() == [3, 1, 2, 0, 0, 0, 4, 1, 1, 0, 1, 3, 0]
    assert sizes.tolist() == [4, 1, 1, 4, 3] and rare == [[b"x"], [], [], [b"c\x1cc", b"\xc3\x89"], [b"x"]]
    for i, text in enumerate(texts):  # what stands beside a text does not count
        one = mixing.Reader(mixing.Lookup(words)).read(next(mixing.stretches([text])))
        a, b = int(sizes[:i].sum()), int(sizes[: i + 1].sum())
        assert all(np.array_equal(x[a:b], y) for x, y in zip(contexts[1:], one[1][1:]))


@pytest.mark.parametrize("held", [1, 60, mixing.HELD])
def test_words_are_counted_in_learning_rows_only(spark, monkeypatch, held):
    monkeypatch.setattr(mixing, "HELD", held)
    rows = [(1, " The the\x0bTHE É é ", 1), (2, None, 1), (3, "the only\x1cone", 0), (4, "", 0), (5, "a\x1fb c \t\n", 2), (6, "The", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    want = Counter()
    for _, text, part in rows:
        for w in [*mixing.words_of(text), *([b""] if part else [])]:
            want[w.decode()] += part != 0
    for n in (1, 3):
        got = mixing.vocabulary(docs.repartition(n)).collect()
        assert {r.word: r.n for r in got} == dict(want) and len(got) == len(want)
    empty = mixing.vocabulary(docs.where(F.lit(False))).collect()
    assert all(r.word == "" and r.n == 0 for r in empty)


def test_word_counts_leave_a_task_as_arrow_arrays(monkeypatch):
    """No word becomes a Python object on the way."""
    monkeypatch.setattr(mixing, "words_of", lambda text: pytest.fail("words were made into objects"))
    run = []

    class Rows:
        select = groupBy = agg = lambda self, *a, **k: self

        def mapInArrow(self, f, schema):
            run.append(f)
            return self

    class Functions:
        def __getattr__(self, name):
            return lambda *a, **k: Functions()

        def __ne__(self, other):
            return self

    monkeypatch.setattr(mixing, "F", Functions())
    mixing.vocabulary(Rows())
    batch = pa.RecordBatch.from_arrays([pa.array(["a B a", "c"]), pa.array([True, False])], ["text", "learns"])
    got = {w: n for b in run[0](iter([batch])) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist())}
    assert got == {"a": 2, "b": 1, "c": 0, "": 1}
