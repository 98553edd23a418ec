"""Byte-level BPE by merge replay over the distinct words of the corpus.

The tokenizer's pattern splits texts into words. A first pass over all texts counts the distinct words that are no
tokens themselves; the commonest, at most `common_words` whatever the corpus holds, are merged once for the whole corpus:
each partition of them lays all bytes out in one array and builds an inverted
index from the rank of a token pair to the positions where the pair stands. The merges are then
replayed in rank order over the whole index, the lowest ranks together: of each word that they list, the places of its own lowest pair are merged, the
others wait for the next step. A step touches only the positions listed for it, and only
the two neighbours of a merged pair enter the index anew. A second pass puts documents together from the words'
ids. Joining every occurrence of a word with its ids would shuffle several times the corpus, so the common words are
sent to all tasks (no more than about 15 MB), and the rare rest of a task's words, each of which is in few texts, is replayed in the same
way beside the texts that hold it.

All places of a pair in a word are merged at once, up to one whose merge makes a pair of lower rank, which goes first; a run of
one letter thus takes a few steps for each doubling. Memory is bounded by `CACHE_BYTES` and the longest text.

Nulls: a null text is the empty text, with no ids. Repeated rows are each encoded. An empty table
gives an empty result. All columns of the input stay; the results go to the columns named.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import portions, slices, stored

#: The most words merged once for the whole corpus, and UTF-8 bytes of the longest of them.
COMMON_WORDS, COMMON_BYTES = 100_000, 64
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Bytes of text whose words a task replays together.
GROUP_BYTES = 16_000_000
#: Bytes of other words and their ids that a worker remembers; beyond them it keeps those that the last group holds more than once.
CACHE_BYTES = 60_000_000
#: What Python needs to hold a word and its ids beside their bytes, about.
ENTRY_BYTES = 200
#: Words are replayed together in portions of about so many bytes.
REPLAY_BYTES = 500_000
#: Places of the index that are merged in one step, at most; fewer where words wait for each other.
AT_ONCE = 20_000
#: Parts that are laid out at once.
LAID_OUT = 250_000
#: Bits of a token id; ids that stand for no token.
SHIFT, BETWEEN, GONE = 20, -1, -2


#: The letters, other numbers and white space below U+0250, for texts without later characters.
LATIN = {"L": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "N": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "s": "\t-\r \x85\xa0"}
BEYOND_LATIN = re.compile("[^\0-\u024f]").search


def latin_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N}, \s and \S spelt out for characters below U+0250, for the faster of two engines."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN['s']}{LATIN['L']}{LATIN['N']}]")
    for name, there in (("\\p{L}", f"[{LATIN['L']}]"), ("\\p{N}", f"[{LATIN['N']}]"), ("\\S", f"[^{LATIN['s']}]"), ("\\s", f"[{LATIN['s']}]")):
        out = out.replace(name, there)
    return out


class Pieces:
    """Byte strings side by side, of items of one kind, to be laid out in any order."""

    def __init__(self, parts: list[bytes], kind: str):
        self.flat = np.frombuffer(b"".join(parts), kind)
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // self.flat.itemsize
        self.starts = np.cumsum(self.lengths) - self.lengths

    def laid_out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of the parts numbered in `at`, and where each part ends."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.flat.dtype)
        for a in range(0, len(at), LAID_OUT):
            own = slice(a, a + LAID_OUT)
            n = lengths[own]
            first = int(ends[a] - n[0])
            last = int(ends[own][-1])
            out[first:last] = self.flat[np.repeat(self.starts[at[own]] - (ends[own] - n - first), n) + np.arange(last - first)]
        return out, ends


def cut(items: np.ndarray, ends: np.ndarray, counts: list[int]) -> list[bytes]:
    """The bytes of texts whose so many parts end at `ends`."""
    stops = np.concatenate(([0], ends))[np.cumsum([0, *counts])] * items.itemsize
    data = items.tobytes()
    return [data[a:b] for a, b in itertools.pairwise(stops.tolist())]


class Numbers(dict):
    """Words and their numbers, given in the order in which words are first asked for."""

    def __init__(self, words: Iterable[str]):
        super().__init__(zip(words, itertools.count()))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class MergeReplay:
    """The merges of a rank file: token bytes by rank, where the rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall
        #: Both parts of a pair as one number, sorted, and the rank of what each pair merges into.
        merges = sorted(
            (ranks[t[:i]] << SHIFT | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        )
        self.keys, self.merged = np.array(merges, np.int64).reshape(-1, 2).T.copy()
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = self.ranks_of(self.byte_ids[:, None], self.byte_ids[None, :])
        self.narrow = np.min_scalar_type(max(ranks.values()))  # numbers of 16 bits are sorted in fewer steps
        self.remember({})

    def split(self, text: str | None) -> list[str]:
        return (self.find if BEYOND_LATIN(text) else self.find_latin)(text) if text else []

    def ranks_of(self, left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
        """The rank of each pair, or -1; a negative id stands between words and makes no pair."""
        key = left.astype(np.int64) * (1 << SHIFT) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1).astype(np.int32)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned numbers of 32 bits; no word is empty."""
        joined = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(lengths + 1, dtype=np.int32)
        tok = self.byte_ids[joined]
        tok[0] = tok[ends] = BETWEEN
        word = np.repeat(np.arange(len(words) + 1, dtype=np.int32), np.concatenate(([1], lengths + 1)))
        after, before = np.arange(1, len(tok) + 1, dtype=np.int32), np.arange(-1, len(tok) - 1, dtype=np.int32)
        pair = np.full(len(tok), -1, np.int32)  # the rank of the pair that begins here
        pair[:-1] = self.byte_pairs[joined[:-1], joined[1:]]
        pair[0] = pair[ends] = pair[ends - 1] = -1
        del joined

        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> where it stands
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks.astype(self.narrow), kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            start = 0
            for rank, end in zip(ranks[np.concatenate(([0], cuts))].tolist(), [*cuts.tolist(), len(at)]):
                if rank in index:
                    index[rank].append(at[start:end])
                else:
                    index[rank] = [at[start:end]]
                    heapq.heappush(heap, rank)
                start = end

        enter(np.arange(len(tok), dtype=np.int32), pair)
        wanted = AT_ONCE
        while heap:
            # The lowest ranks of the index together; a word's lowest pair is among them if any pair of it is.
            listed, of, held = [], [], 0
            while heap and (not held or held + sum(map(len, index[heap[0]])) <= wanted):
                rank = heapq.heappop(heap)
                for own in index.pop(rank):
                    listed.append(own)
                    of.append(rank)
                    held += len(own)
            at = np.concatenate(listed)
            at = at[pair[at] == np.repeat(np.array(of, np.int32), [len(x) for x in listed])]
            if not len(at):
                continue
            at.sort()  # a place may be listed more than once
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            # Of each word only the places of its lowest pair.
            rank, own = pair[at], word[at]
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            lowest = rank == np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(at))))
            wait = [at[~lowest]]
            wanted = min(2 * wanted, AT_ONCE) if 2 * len(wait[0]) <= len(at) else max(1, wanted // 2)
            at = at[lowest]
            # Of pairs that overlap, every other one from the left.
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(chained, 0, order))
            chosen = at[(order - run) % 2 == 0]
            # Taken from left to right in a word, each makes two pairs; one of lower rank than this has to go first.
            rank, beyond = pair[chosen], after[after[chosen]]
            joined = np.concatenate(([False], beyond[:-1] == chosen[1:]))
            left_ranks = self.ranks_of(np.where(joined, rank, tok[before[chosen]]), rank)
            right_ranks = self.ranks_of(rank, tok[beyond])
            first = ((left_ranks >= 0) & (left_ranks < rank)) | ((right_ranks >= 0) & (right_ranks < rank))
            if first.any():
                own = word[chosen]
                so_far = np.cumsum(first) - first
                new = np.concatenate(([True], own[1:] != own[:-1]))
                good = so_far == np.maximum.accumulate(np.where(new, so_far, 0))
                wait.append(np.setdiff1d(at, chosen[good], assume_unique=True))
                chosen, rank, left_ranks, right_ranks, joined = chosen[good], rank[good], left_ranks[good], right_ranks[good], joined[good]
            at = chosen
            gone = after[at]
            beyond = after[gone]
            after[at], before[beyond] = beyond, at
            tok[at], tok[gone], pair[gone] = rank, GONE, -1
            # Where the next place was merged as well, the pair to the right is that next place's pair to the left.
            follow = np.flatnonzero(joined)
            right_ranks[follow - 1] = left_ranks[follow]
            left = before[at]
            pair[at], pair[left] = right_ranks, left_ranks
            entered = np.concatenate((at, left, *wait))
            enter(entered, pair[entered])
        stays = tok >= 0
        data = tok[stays].astype("<u4").tobytes()
        cuts = (np.cumsum(stays)[ends] * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def remember(self, common: dict[str, bytes], kept: dict[str, bytes] | None = None) -> None:
        """Begins anew with words whose ids are known; those of `kept` count as held."""
        self.common = common
        known = common | kept if kept else common
        self.numbers, self.ids = Numbers(known), list(known.values())
        self.held = sum(len(w) + len(ids) + ENTRY_BYTES for w, ids in (kept or {}).items() if w not in common)
        self.pieces = Pieces(self.ids, "<u4")

    def keep_repeated(self, numbers: list[array]) -> None:
        """Forgets all but the common words and those that texts of such numbers hold more than once; if these are too many as well, all of them."""
        often = np.bincount(np.frombuffer(b"".join(n.tobytes() for n in numbers), np.intc), minlength=len(self.ids)) > 1
        self.remember(self.common, dict(itertools.compress(zip(self.numbers, self.ids), often.tolist())))
        if 4 * self.held > 3 * CACHE_BYTES:
            self.remember(self.common)

    def numbered(self, text: str | None) -> array:
        """The numbers of the text's words; words not met before wait to be learned."""
        return array("i", map(self.numbers.__getitem__, self.split(text)))

    def learn(self) -> None:
        """Finds the ids of the words that wait, as little-endian numbers of 32 bits; those that are no tokens are replayed in portions."""
        new = self.numbers.new
        for start, end in _cuts(new):
            raw = [w.encode() for w in new[start:end]]
            ids = [b"" if (whole := self.ranks.get(r)) is None else whole.to_bytes(4, "little") for r in raw]
            open_ = [i for i, x in enumerate(ids) if not x]
            for i, found in zip(open_, self.replay([raw[i] for i in open_]) if open_ else ()):
                ids[i] = found
            self.ids += ids
            self.held += sum(map(len, raw)) + sum(map(len, ids)) + ENTRY_BYTES * len(raw)
        if new:
            self.pieces = Pieces(self.ids, "<u4")
        new.clear()

    def joined(self, numbers: list[array]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The ids of texts in one array, where each word's end, and the words of each text."""
        at = np.frombuffer(b"".join(n.tobytes() for n in numbers), np.intc)
        return *self.pieces.laid_out(at), [len(n) for n in numbers]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned numbers of 32 bits."""
        numbers = [self.numbered(t) for t in texts]
        self.learn()
        return cut(*self.joined(numbers))


def _cuts(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words of about REPLAY_BYTES."""
    start = held = 0
    for i, word in enumerate(words):
        held += len(word)
        if held > REPLAY_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(words):
        yield start, len(words)


def groups(batches: Iterator[pa.RecordBatch], text: str, rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, in lists of about GROUP_BYTES of text."""
    group: list[pa.RecordBatch] = []
    held = 0
    for batch in portions(batches, text, rows, 2_000_000):
        group.append(batch)
        held += batch.column(text).nbytes
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def ranks_in(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def replay_of(path: str, pattern: str) -> MergeReplay:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    return MergeReplay(ranks_in(path), pattern)


@functools.lru_cache(2)
def tokens_of(path: str) -> Pieces:
    """The bytes of each id."""
    ranks = ranks_in(path)
    parts = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        parts[rank] = token
    return Pieces(parts, "u1")


def common_words(docs: DataFrame, path: str, pattern: str, text: str = "text", most: int = COMMON_WORDS) -> DataFrame:
    """word and token_ids of the commonest words of all texts that are no tokens themselves, at most so many."""

    def count(batches):
        model = replay_of(path, pattern)
        counts: Counter[str] = Counter()

        def flush():
            ranks = model.ranks
            rows = [(w, n) for w, n in counts.items() if len(data := w.encode()) <= COMMON_BYTES and data not in ranks]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in portions(batches, text, 1024, 4_000_000):
            for t in batch.column(text).to_pylist():
                counts.update(model.split(t))
            if len(counts) > COUNTED:
                yield flush()
        yield flush()

    def merge(batches):
        model = replay_of(path, pattern)
        for batch in slices(batches, 50_000):
            ids = model.replay([w.encode() for w in batch.column("word").to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], ["word", "token_ids"])

    counts = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 8).cast("int")  # few levels, so that their sizes say where to cut
    counts = stored(counts.where("n > 1").withColumn("level", level), "word-counts")
    held, least = 0, None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    wanted = counts.where(F.col("level") >= least if least is not None else F.lit(False)).select("word")
    return wanted.mapInArrow(merge, "word string, token_ids binary")


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None, rows: int = 1024, most_common: int = COMMON_WORDS, width: int = 4
) -> DataFrame:
    """docs with the ids of each text, little-endian numbers of `width` bytes, as binary in column `out`. path: a rank file that every executor has.

    A width of 2 leaves the largest two numbers free and fails for a vocabulary that needs them.

    With `decoded` the same task also decodes the ids into the column of that name, so that one worker does both.
    """
    names = [out, *([decoded] if decoded else [])]
    docs = docs.drop(*names)
    found = common_words(docs, path, pattern, text, most_common).toArrow() if most_common else pa.table({"word": [], "token_ids": []})
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(found.column("word").to_pylist(), found.column("token_ids").to_pylist())))  # most_common words at most

    def run(batches):
        model = replay_of(path, pattern)
        if model.common is not sent.value:
            model.remember(sent.value)
        if width < 4 and max(model.ranks.values()) >= (1 << 8 * width) - 2:
            raise ValueError(f"the vocabulary has ids of more than {width} bytes")
        for group in groups(batches, text, rows):
            numbers = [[model.numbered(t) for t in batch.column(text).to_pylist()] for batch in group]
            model.learn()
            for batch, own in zip(group, numbers):
                ids, ends, words = model.joined(own)
                new = [pa.array(cut(ids.astype(f"<u{width}"), ends, words), pa.binary())]
                if decoded:
                    counts = np.diff(np.concatenate(([0], ends))[np.cumsum([0, *words])]).tolist()
                    new.append(pa.array(cut(*tokens_of(path).laid_out(ids), counts), pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
            if model.held > CACHE_BYTES:
                model.keep_repeated([n for own in numbers for n in own])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)]))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded", rows: int = 1024) -> DataFrame:
    """docs with the bytes that the ids stand for, in column `out`; null ids decode to no bytes."""

    docs = docs.drop(out)

    def run(batches):
        token = tokens_of(path)
        for batch in portions(batches, ids, rows, 4_000_000):
            raw = [x or b"" for x in batch.column(ids).to_pylist()]
            data = cut(*token.laid_out(np.frombuffer(b"".join(raw), "<u4")), [len(x) // 4 for x in raw])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir):
    from .shared import table

    path, pattern = public_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, pattern, decoded="decoded").select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
