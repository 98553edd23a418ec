"""The merge replay: its memory, its steps, and what it remembers between groups of texts."""

import random
import tracemalloc

from stratapoint.llm import bpe

rng = random.Random(5)


def words(n: int) -> list[str]:
    return list({"".join(rng.choices("etaoinshrdlu", k=rng.randrange(5, 14))) for _ in range(n)})


def model() -> bpe.MergeReplay:
    path, pattern = bpe.public_vocabulary()
    return bpe.MergeReplay(bpe.ranks_in(path), pattern)


def plain(ranks: dict[bytes, int], word: bytes) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_many_new_words_take_little_memory():
    own = model()
    text = own.numbered(" ".join(words(250_000)))
    tracemalloc.start()
    own.learn()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(text)) > 240_000 and peak < 80_000_000


def test_ranks_are_merged_together():
    own, calls = model(), 0
    found = own.ranks_of

    def counted(*x):
        nonlocal calls
        calls += 1
        return found(*x)

    own.ranks_of = counted
    given = [w.encode() for w in words(20_000)]
    given += [bytes(rng.choices(b"ab ", k=rng.randrange(1, 90))) for _ in range(300)] + [bytes(rng.choices(range(256), k=rng.randrange(1, 60))) for _ in range(300)]
    got = own.replay(given)
    assert calls < 2_000
    for word, ids in [*zip(given, got)][-1500:]:
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == plain(own.ranks, word)


def test_repeated_words_stay_and_ids_do_not_change():
    own = model()
    own.remember({"qzqzx": own.encode(["qzqzx"])[0]})
    texts = ["onceqq twicezz", "twicezz qzqzx", None]
    before = own.encode(texts)
    own.keep_repeated([own.numbered(t) for t in texts])
    assert " twicezz" not in own.numbers and "qzqzx" in own.numbers  # " twicezz" and "twicezz" are two words
    own.encode(texts)
    own.keep_repeated([own.numbered(t) for t in texts * 2])
    assert {" twicezz", "twicezz", "onceqq", "qzqzx"} <= own.numbers.keys() and own.held > 0
    assert own.encode(texts) == before and not own.numbers.new
