"""Look-ups of the LM's tables and the list of words outside the tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.llm import mixing


def test_bytes_of_tables_are_stretched_by_one_look_up():
    numbers = np.arange(-128, 128).astype(np.int8)
    want = np.where(numbers == mixing.NEVER, 0, numbers.astype(np.float32) / mixing.SCALE)
    assert mixing.STRETCHED[numbers.view(np.uint8)] == pytest.approx(want, rel=1e-6)


def test_words_outside_the_tree_are_listed_by_row(spark):
    words = mixing.Language({b"the": 2, b"of": 3}, np.array([5, 0, 9, 4]), 18, 3)
    mixer = mixing.Mixer.plain(mixing.Code.of([5, 2, 9, 4]), np.zeros((mixing.WORD_CONTEXTS, 1 << mixing.SLOT_BITS), np.int8))
    docs = spark.createDataFrame([(1, "the Cat of cat dog"), (2, None), (3, "of"), (4, "dog é")], "doc_id long, text string").withColumn("part", F.lit(1))
    got = {r.doc_id: {x.word: x.times for x in r.rare} for r in mixing.scored_words(docs.coalesce(1), words, mixer).collect()}
    assert got == {1: {"cat": 2, "dog": 1}, 2: {}, 3: {}, 4: {"dog": 1, "é": 1}}
