"""LM scoring by online logistic context mixing.

A text is a sequence of lower-cased words and one end. Each word is a run of binary decisions down a Huffman tree over the common
words, the end and an escape; a word outside that tree is an escape followed by its bytes and a stop, each a run down a second tree. Every decision is
predicted by several contexts (nothing, the word before, the two and three before, the one before the last; within a word the last 1 to 6
bytes), each of which is hashed with the decision's place in the tree into a table of learned counts. The stretched
probabilities are added up by weights that a gate chooses (which contexts were ever seen, how deep the decision lies), online weights of
the text's own are added, moved by the errors on its earlier decisions, and a last table refines the sum by what
came of such sums. The logarithms of all decisions add up to that of the text, a proper probability of its words.

Learning is three passes of Spark over the learning rows: words are counted, context tables are counted in tasks and added up segment by segment,
and the weights are learned online in tasks from the learning rows of one fold, which the tables leave out, and averaged. Tables and
tree have a fixed size at any size of the corpus; counts of words grow with it and never leave Spark. Words outside the tree are spelt once for the
whole corpus, not once for each occurrence, and joined with the rows that hold them.

The base score is that of single words, smoothed by 0.1. A null text is empty: its only token is the end. Repeated rows are each scored (and count). Without
learning rows every decision is a coin toss, and the base of an empty vocabulary is log10(0.1 / 0.1) = 0 for each token. Very long
texts are scored in stretches of STRETCH words that hand contexts and weights on. An empty table gives an empty result.
All columns but doc_id and text are dropped.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import fold, forget, portions, stored

FOLDS, HELD_OUT, LESSONS = 10, 0, 1
#: Words of the tree at most, slots of a context's table, counters of a segment in which tables are added up.
COMMON, SLOT_BITS, SEGMENT = 1 << 18, 21, 1 << 16
SMOOTHING = 0.1
STRETCH, PORTION = 50_000, 300_000
#: Bytes of text of a task after which the counts of its words leave it.
HELD = 8_000_000
#: Decisions after which a text's own weights move, and how far; the same for the shared weights of the gates.
BLOCK, OWN_RATE, RATE = 512, 0.002, 0.02
#: Steps of the final refinement: from -8 to 8 by quarters.
STEPS = 64
PRIOR, SCALE, NEVER = 0.4, 15.0, -128
END, ESCAPE = 0, 1
STOP = 256
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
WORD_CONTEXTS, BYTE_CONTEXTS = 5, 5
NOTHING = np.uint32(0)
#: What a byte of a table stands for, by the byte without its sign.
STRETCHED = np.arange(256).astype(np.uint8).view(np.int8).astype(np.float32) * np.float32(1 / SCALE)
STRETCHED[np.int8(NEVER).view(np.uint8)] = 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


@dataclass
class Code:
    """A Huffman tree: where each symbol's decisions begin and how many they are; of each decision its place in the tree, its depth (7 at
    most) and its outcome, in one number. A block of empty decisions follows that of the symbols."""

    start: np.ndarray
    length: np.ndarray
    steps: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Code:
        n = len(counts)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.full(2 * n - 1, -1, np.int64), np.zeros(2 * n - 1, np.uint8)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            side[j] = 1
            heapq.heappush(heap, (a + b, node))
        length, at = np.zeros(n, np.int64), np.arange(n)
        while (up := parent[at] >= 0).any():
            length += up
            at = np.where(up, parent[at], at)
        start = np.cumsum(length) - length
        steps = np.zeros(length.sum() + BLOCK, np.uint32)
        symbol, at, left = np.arange(n), np.arange(n), length.copy()
        while len(symbol := symbol[left[symbol] > 0]):
            node, left[symbol] = at[symbol], left[symbol] - 1
            here = start[symbol] + left[symbol]
            steps[here] = parent[node] - n + 1 << 4 | np.minimum(left[symbol], 7) << 1 | side[node]
            at[symbol] = parent[node]
        return cls(start, length, steps)

    @property
    def place(self) -> np.ndarray:
        return places(self.steps)

    @property
    def bit(self) -> np.ndarray:
        return bits(self.steps)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a sequence of symbols: the index of each decision, and how many each symbol has."""
        return _runs(self.start[symbols], self.length[symbols])

    def blocks(self, symbols: np.ndarray, contexts: list[np.ndarray | None], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None], np.ndarray]:
        """As decisions, of texts of so many symbols, each filled up to whole blocks with empty decisions; and the contexts that go with
        them, and how many decisions each text has without these."""
        start, n, ends = self.start[symbols], self.length[symbols], np.cumsum(sizes)
        decided = np.concatenate(([0], np.cumsum(n)))
        held = decided[ends] - decided[ends - sizes]
        at, n = _runs(np.insert(start, ends, len(self.steps) - BLOCK), np.insert(n, ends, -held % BLOCK))
        return at, n, [None if c is None else np.insert(c, ends, 0) for c in contexts], held


def _runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(start - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return at, n


def places(steps: np.ndarray) -> np.ndarray:
    return (steps >> np.uint32(4)) * _A


def bits(steps: np.ndarray) -> np.ndarray:
    return (steps & np.uint32(1)).astype(np.uint8)


def slots(place: np.ndarray, context: np.ndarray) -> np.ndarray:
    h = place ^ context
    h *= _B
    h ^= h >> np.uint32(15)
    h *= _C
    h >>= np.uint32(32 - SLOT_BITS)
    return h


def word_contexts(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[np.ndarray | None]:
    """Of each word: its contexts, from the hashes of the last word before it, the one before that, and the third."""
    one = (a + np.uint32(1)) * _C
    two = (one ^ b) * _A + np.uint32(2)
    return [None, one, two, (two ^ c) * _B + np.uint32(3), (b + np.uint32(4)) * _A]


def spelling(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bytes and stops of the words, their contexts, and how many symbols each word has."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.full(int(n.sum()), STOP, np.int64)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(n) - 1] = False
    flat[inside] = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    h, out = np.zeros(len(flat), np.uint32), []
    for back in range(1, 7):
        before = np.full(len(flat), 300, np.uint32)
        before[back:] = flat[:-back]
        h = (h ^ np.where(at >= back, before, 300).astype(np.uint32)) * _A + np.uint32(back)
        if back != 5:
            out.append(h * _C)
    return flat, out, n


class Tables:
    """Counts of zeros and ones in every slot of every context."""

    def __init__(self, code: Code, contexts: int):
        self.code = code
        self.counts = [np.zeros(2 << SLOT_BITS, np.uint32) for _ in range(contexts)]
        self.symbols = np.zeros(len(code.start), np.int64)

    def add(self, symbols: np.ndarray, contexts: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        """contexts[0] is None where nothing before a symbol counts: then its decisions follow from how often it occurs."""
        at, n = self.code.decisions(symbols)
        steps = self.code.steps[at]
        place, bit = places(steps), steps & np.uint32(1)
        by = np.ones(len(at), np.uint32) if weights is None else np.repeat(weights, n).astype(np.uint32)
        for counts, context in zip(self.counts, contexts):
            if context is None:
                np.add.at(self.symbols, symbols, 1 if weights is None else weights)
                continue
            at = slots(place, np.repeat(context, n))
            at <<= np.uint32(1)
            at |= bit
            np.add.at(counts, at.astype(np.intp), by)

    def parts(self) -> Iterator[pa.RecordBatch]:
        """Context, segment and packed counts of every segment that has any, as numbers of the fewest bytes that hold them."""
        code = self.code
        steps = code.steps[:-BLOCK]
        np.add.at(self.counts[0], slots(places(steps), NOTHING) << np.uint32(1) | bits(steps), np.repeat(self.symbols, code.length).astype(np.uint32))
        for k, counts in enumerate(self.counts):
            for s in range(0, len(counts), SEGMENT):
                part = counts[s : s + SEGMENT]
                if most := int(part.max()):
                    part = part.astype(np.min_scalar_type(most))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s // SEGMENT], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)])], ["context", "segment", "width", "counts"])


PARTS, SUMS = "context int, segment int, width int, counts binary", "context int, segment int, counts binary"


def stretched(parts: DataFrame, contexts: int) -> np.ndarray:
    """The sums of the tasks' tables, as stretched probabilities in a byte: contexts * 2^SLOT_BITS bytes at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, s, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(pa.decompress(packed, width * SEGMENT, "zstd"), f"u{width}")
                own[k, s] = own[k, s] + part if (k, s) in own else part.astype(np.int64)
        for (k, s), n in own.items():
            zeros, ones = n[0::2], n[1::2]
            z = np.clip(np.rint(np.log((ones + PRIOR) / (zeros + PRIOR)) * SCALE), -127, 127)
            out = np.where(zeros + ones == 0, NEVER, z).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([out.tobytes()])], ["context", "segment", "counts"])

    tables = np.full((contexts, 1 << SLOT_BITS), NEVER, np.int8)
    for r in parts.repartition(64, "context", "segment").mapInArrow(run, SUMS).collect():
        at = r.segment * (SEGMENT // 2)
        tables[r.context, at : at + SEGMENT // 2] = np.frombuffer(r.counts, np.int8)
    return tables


@dataclass
class Mixer:
    """Tables of all contexts, weights by gate and context, and the refinement by gate and step."""

    code: Code
    tables: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def plain(cls, code: Code, tables: np.ndarray) -> Mixer:
        contexts = len(tables)
        gates = 8 << (contexts - 1)
        middle = 1 / (1 + np.exp(-((np.arange(STEPS) + 0.5) / 4 - 8)))
        return cls(code, tables, np.full((gates, contexts), 0.4, np.float32), np.tile(middle, (gates, 1)).astype(np.float32))

    @cached_property
    def alone(self) -> np.ndarray:
        """What the first table says of every decision where nothing before it counts."""
        return self.tables[0][slots(self.code.place, NOTHING)]

    def inputs(self, at: np.ndarray, n: np.ndarray, contexts: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each decision: the stretched predictions, the gate and the outcome."""
        steps = self.code.steps[at]
        place, gate = places(steps), (steps >> np.uint32(1) & np.uint32(7)).astype(np.uint8)
        x = np.empty((len(self.tables), len(at)), np.float32)
        for k, (table, context) in enumerate(zip(self.tables, contexts)):
            got = self.alone[at] if context is None else table[slots(place, np.repeat(context, n)).astype(np.intp)]
            np.take(STRETCHED, got.view(np.uint8), out=x[k], mode="clip")
            if k:
                gate |= (got != NEVER).view(np.uint8) << np.uint8(k + 2)
        return x, gate.astype(np.intp), bits(steps)

    def sums(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z, own = np.zeros(len(gate), np.float32), np.empty(len(gate), np.float32)
        for weights, inputs in zip(np.ascontiguousarray(self.weights.T), x):
            np.take(weights, gate, out=own, mode="clip")
            own *= inputs
            z += own
        return z

    def log10(self, z: np.ndarray, gate: np.ndarray, bit: np.ndarray, chances: np.ndarray | None = None) -> np.ndarray:
        """Of the outcome of each decision; chances are what the sums z say of a one."""
        step = np.clip((z + 8) * 4, 0, STEPS - 1).astype(np.intp)
        step += gate * STEPS
        p = self.refined.reshape(-1)[step]
        p += 1 / (1 + np.exp(-z)) if chances is None else chances
        p *= np.float32(0.5)
        np.clip(p, 1e-4, 1 - 1e-4, out=p)
        return np.log(np.where(bit, p, 1 - p)) * np.float32(1 / math.log(10))

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, seen: np.ndarray) -> None:
        """Moves the weights online, and counts in seen what came of which sum."""
        gates, size, steps = len(self.weights), 2048, np.empty(len(gate), np.int64)
        for i in range(0, len(gate), size):
            g, b, own = gate[i : i + size], bit[i : i + size], x[:, i : i + size]
            z = self.sums(own, g)
            error = b - 1 / (1 + np.exp(-z))
            often = np.sqrt(np.maximum(1, np.bincount(g, minlength=gates)))
            for k in range(len(x)):
                self.weights[:, k] += RATE * np.bincount(g, error * own[k], gates) / often
            steps[i : i + size] = np.clip((z + 8) * 4, 0, STEPS - 1)
        seen += np.bincount((gate * STEPS + steps) * 2 + bit, minlength=2 * gates * STEPS)


def adapted(x: np.ndarray, z: np.ndarray, bit: np.ndarray, size: np.ndarray, own: np.ndarray, chances: np.ndarray | None = None) -> np.ndarray:
    """Sums with each text's own weights added, which move after every block by the errors in it; chances is filled with what they say of a one.

    Texts follow each other with `size` decisions each, whole blocks of them, inputs of zero behind a text's end; own (texts, contexts) holds
    their weights and is left as they end.
    """
    blocks = size // BLOCK
    order = np.argsort(-blocks, kind="stable")
    first, falling = (np.cumsum(blocks) - blocks)[order], -blocks[order]
    texts = np.searchsorted(falling, -np.arange(int(blocks.max(initial=0))), "left")  # those that have a block at each step
    ends = np.cumsum(texts)
    rank = np.arange(int(texts.sum())) - np.repeat(ends - texts, texts)
    at = first[rank] + np.repeat(np.arange(len(texts)), texts)  # blocks by steps, so that those of a step lie together
    x, bit, mine = x.reshape(len(x), -1, BLOCK).take(at, axis=1), bit.reshape(-1, BLOCK)[at], own[order]
    sums = z.reshape(-1, BLOCK)[at]
    told = np.empty_like(sums)
    for n, end in zip(texts.tolist(), ends.tolist()):
        inputs, now, chance = x[:, end - n : end], sums[end - n : end], told[end - n : end]
        now += np.einsum("ktb,tk->tb", inputs, mine[:n])
        np.exp(np.negative(now, out=chance), out=chance)
        chance += 1
        np.reciprocal(chance, out=chance)
        mine[:n] += OWN_RATE * np.einsum("ktb,tb->tk", inputs, bit[end - n : end] - chance)
    own[order] = mine
    out = np.empty_like(sums)
    out[at] = sums
    if chances is not None:
        chances[at] = told
    return out.reshape(-1)


@dataclass
class Language:
    """The common words with their counts and hashes, and how many tokens and distinct tokens were learned from."""

    numbers: Lookup | dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))


def stretches(texts: list[str | None], held: int = STRETCH) -> Iterator[list[tuple[int, list[bytes], bool, bool]]]:
    """Groups of (row, words, whether the row begins, whether it ends) of about so many words."""
    group, n = [], 0
    for row, text in enumerate(texts):
        words = words_of(text)
        for i in range(0, max(1, len(words)), held):
            part = words[i : i + held]
            group.append((row, part, i == 0, i + held >= len(words)))
            n += len(part)
            if n >= held:
                yield group
                group, n = [], 0
    if group:
        yield group


class Lookup:
    """The numbers of the common words, by their 64-bit hashes in this process: a table of open addresses, looked up for many words at
    once. Words count from ESCAPE + 1 on, all others are ESCAPE. Only the words travel; the arrays are built once in each worker."""

    def __init__(self, words: Iterable[bytes]):
        self.words = list(words)

    def __reduce__(self):
        return Lookup, (self.words,)

    @cached_property
    def hashes(self) -> np.ndarray:
        """By number, the hashes that contexts are made of."""
        return np.array([0, 0, *map(xxhash.xxh32_intdigest, self.words)], np.uint32)

    @cached_property
    def keys(self) -> np.ndarray:
        return np.fromiter(chain((0, 0), map(hash, self.words)), np.int64, len(self.words) + 2)

    @cached_property
    def table(self) -> np.ndarray:
        """The number at each address, 0 where there is none; half of the addresses at most are taken."""
        table = np.zeros(2 << max(4, len(self.words).bit_length()), np.int32)
        left = np.arange(ESCAPE + 1, len(self.keys), dtype=np.int32)
        at = self.keys & len(table) - 1
        while len(left):
            here = at[left]
            free = table[here] == 0
            table[here[free]] = left[free]
            left = left[table[here] != left]
            at[left] = at[left] + 1 & len(table) - 1
        return table

    def find(self, words: list[bytes]) -> np.ndarray:
        keys, table = self.keys, self.table
        key = np.fromiter(map(hash, words), np.int64, len(words))
        at = key & len(table) - 1
        found = table[at]
        left = np.flatnonzero((keys[found] != key) & (found > 0))
        while len(left):
            at[left] = at[left] + 1 & len(table) - 1
            found[left] = here = table[at[left]]
            left = left[(keys[here] != key[left]) & (here > 0)]
        return np.maximum(found, ESCAPE).astype(np.int64)


class Reader:
    """Turns groups of texts into symbols and contexts; remembers where a long text was left."""

    def __init__(self, numbers: Lookup | dict[bytes, int]):
        self.lookup, self.last = numbers if isinstance(numbers, Lookup) else Lookup(numbers), np.zeros(3, np.uint32)

    def read(self, group: list[tuple[int, list[bytes], bool, bool]]) -> tuple[np.ndarray, list[np.ndarray | None], np.ndarray, list[list[bytes]]]:
        """Symbols and contexts of all words and ends, how many each text has, and its words outside the tree."""
        words = list(chain.from_iterable(own for _, own, _, _ in group))
        n, ends = np.array([len(own) for _, own, _, _ in group]), np.array([ends for *_, ends in group], np.int64)
        found = self.lookup.find(words)
        hashed, rare_at = self.lookup.hashes[found], np.flatnonzero(found == ESCAPE)
        rare = [words[i] for i in rare_at.tolist()]
        hashed[rare_at] = np.fromiter(map(xxhash.xxh32_intdigest, rare), np.uint32, len(rare))
        sizes, texts = n + ends, np.arange(len(group))
        place = np.arange(len(words)) + np.repeat(np.cumsum(ends) - ends, n)
        symbols = np.full(int(sizes.sum()), END, np.int64)
        symbols[place] = found
        way = np.zeros(len(symbols) + 3 * len(group), np.uint32)  # three words before each text
        way[place + 3 * np.repeat(texts + 1, n)] = hashed
        if not group[0][2]:
            way[:3] = self.last
        self.last = way[-3:].copy()
        at = np.arange(len(symbols)) + 3 * np.repeat(texts + 1, sizes)
        cut = [0, *np.searchsorted(rare_at, np.cumsum(n)).tolist()]
        return symbols, word_contexts(way[at - 1], way[at - 2], way[at - 3]), sizes, [rare[i:j] for i, j in zip(cut, cut[1:])]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences in learning rows; the end is the empty word. Words of other rows are there with 0."""

    def words(texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()))).flatten()

    def told(learned: list[pa.Array], others: list[pa.Array], ends: int) -> Iterator[pa.RecordBatch]:
        counts = pc.value_counts(pa.chunked_array(learned, pa.string()))
        known, more = counts.field("values"), pc.unique(pa.chunked_array(others, pa.string()))
        more = more.filter(pc.invert(pc.is_in(more, value_set=known)))
        none = pa.array(np.zeros(len(more), np.int64))
        for word, n in ((known, counts.field("counts")), (more, none)):
            there = pc.not_equal(word, "")  # what stands before and after outer white space
            yield from pa.Table.from_arrays([word.filter(there), n.filter(there)], ["word", "n"]).to_batches(100_000)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others, ends, held = [], [], 0, 0
        for batch in portions(batches, "text", 1 << 20, 1_000_000):
            text, learns = batch.column("text"), batch.column("learns")
            learned.append(words(text.filter(learns)))
            others.append(words(text.filter(pc.invert(learns))))
            ends += pc.sum(learns).as_py() or 0
            held += pc.sum(pc.binary_length(text)).as_py() or 0
            if held >= HELD:
                yield from told(learned, others, ends)
                learned, others, ends, held = [], [], 0, 0
        yield from told(learned, others, ends)
        learned, others = [], []
        pa.default_memory_pool().release_unused()  # the worker lives on

    found = docs.select("text", (F.col("part") != HELD_OUT).alias("learns")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """All words that occur at least so often that they are no more than `most`; the bound is found on a histogram of eighths of powers of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    seen = counts.where("word <> '' AND n > 1").select("word", "n", step.alias("step"))
    total, least = 0, None
    for r in sorted(seen.groupBy("step").count().collect(), reverse=True):
        if (total := total + r["count"]) > most:
            break
        least = r.step
    if least is None:
        return []
    return sorted((r.word, r.n) for r in seen.where(F.col("step") >= least).select("word", "n").collect())


def mean_of(rows: DataFrame, mixer: Mixer) -> Mixer:
    """The tasks' weights, each counted by its decisions, and the refinement from what all tasks saw."""
    gates, contexts = mixer.weights.shape
    weights, total, seen = np.zeros((gates, contexts)), 0, np.zeros((gates, STEPS, 2))
    n = 2 * gates * STEPS
    mean = rows.select(F.posexplode("values").alias("i", "v"), "decisions").groupBy("i").agg(F.sum(F.col("v") * F.when(F.col("i") < gates * contexts, F.col("decisions")).otherwise(1.0)).alias("v"), F.sum("decisions").alias("n"))
    got = {r.i: (r.v, r.n) for r in mean.collect()}
    if not got:
        return mixer
    values = np.array([got[i][0] for i in range(gates * contexts + n)])
    total = got[0][1]
    weights = (values[: gates * contexts] / max(1, total)).reshape(gates, contexts).astype(np.float32)
    seen = values[gates * contexts :].reshape(gates, STEPS, 2)
    refined = (seen[..., 1] + 16 * mixer.refined) / (seen.sum(axis=-1) + 16)
    return Mixer(mixer.code, mixer.tables, weights, refined.astype(np.float32))


LEARNED = "values array<double>, decisions long"


def learned_rows(mixer: Mixer, seen: np.ndarray, decisions: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate((mixer.weights.reshape(-1), seen)).tolist()], pa.list_(pa.float64())), pa.array([decisions], pa.int64())], ["values", "decisions"])


def learn_words(docs: DataFrame, numbers: Lookup, code: Code) -> Mixer:
    """The mixer of word decisions: tables from all learning rows but the lessons, weights from the lessons."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((numbers, code))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, code = sent.value
        reader, tables = Reader(numbers), None
        for batch in portions(batches, "text", 1 << 12, PORTION):
            for group in stretches(batch.column("text").to_pylist()):
                tables = tables or Tables(code, WORD_CONTEXTS)
                symbols, contexts, *_ = reader.read(group)
                tables.add(symbols, contexts)
        yield from tables.parts() if tables else ()

    parts = docs.where((F.col("part") != HELD_OUT) & (F.col("part") != LESSONS)).select("text").mapInArrow(count, PARTS)
    tables = sc.broadcast(stretched(parts, WORD_CONTEXTS))

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, code = sent.value
        reader, mixer, decisions = Reader(numbers), Mixer.plain(code, tables.value), 0
        seen = np.zeros(2 * len(mixer.weights) * STEPS)
        for batch in portions(batches, "text", 1 << 12, PORTION):
            for group in stretches(batch.column("text").to_pylist()):
                symbols, contexts, *_ = reader.read(group)
                x, gate, bit = mixer.inputs(*code.decisions(symbols), contexts)
                mixer.learn(x, gate, bit, seen)
                decisions += len(bit)
        if decisions:
            yield learned_rows(mixer, seen, decisions)

    rows = docs.where(F.col("part") == LESSONS).select("text").mapInArrow(lessons, LEARNED)
    return mean_of(rows, Mixer.plain(code, tables.value))


def spelt_apart(word: bytes) -> bool:
    """Whether a word teaches weights and not tables."""
    return xxhash.xxh32_intdigest(word, 7) % 10 == 1


def learn_spelling(rare: DataFrame, code: Code) -> Mixer:
    """The mixer of spelling decisions, from the rare words of learning rows by their occurrences."""
    sc = rare.sparkSession.sparkContext
    sent = sc.broadcast(code)
    known = rare.where("n > 0")

    def words(batches: Iterator[pa.RecordBatch], apart: bool) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for batch in portions(batches, "word", 10_000, PORTION):
            rows = [(w.encode(), n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())]
            if rows := [r for r in rows if spelt_apart(r[0]) == apart]:
                yield [r[0] for r in rows], np.array([r[1] for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for own, n in words(batches, False):
            tables = tables or Tables(sent.value, BYTE_CONTEXTS)
            symbols, contexts, sizes = spelling(own)
            tables.add(symbols, contexts, np.repeat(n, sizes))
        yield from tables.parts() if tables else ()

    tables = sc.broadcast(stretched(known.mapInArrow(count, PARTS), BYTE_CONTEXTS))

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, decisions = Mixer.plain(sent.value, tables.value), 0
        seen = np.zeros(2 * len(mixer.weights) * STEPS)
        for own, _ in words(batches, True):
            symbols, contexts, _ = spelling(own)
            x, gate, bit = mixer.inputs(*mixer.code.decisions(symbols), contexts)
            mixer.learn(x, gate, bit, seen)
            decisions += len(bit)
        if decisions:
            yield learned_rows(mixer, seen, decisions)

    return mean_of(known.mapInArrow(lessons, LEARNED), Mixer.plain(sent.value, tables.value))


def spelt(rare: DataFrame, mixer: Mixer) -> DataFrame:
    """rare words with n and spelt, the logarithm of each one's spelling."""
    sent = rare.sparkSession.sparkContext.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "word", 10_000, PORTION):
            symbols, contexts, sizes = spelling([w.encode() for w in batch.column("word").to_pylist()])
            at, n = sent.value.code.decisions(symbols)
            x, gate, bit = sent.value.inputs(at, n, contexts)
            logs = sent.value.log10(sent.value.sums(x, gate), gate, bit).astype(float)
            ends = np.cumsum(np.add.reduceat(n, np.cumsum(sizes) - sizes))
            total = np.concatenate(([0.0], np.cumsum(logs)))[np.concatenate(([0], ends))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.diff(total))], ["word", "n", "spelt"])

    return rare.select("word", "n").mapInArrow(run, "word string, n long, spelt double")


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<struct<word:string,times:long>>"


def scored_words(docs: DataFrame, language: Language, mixer: Mixer) -> DataFrame:
    """The columns SCORED: sums over all but rare words, which are listed."""
    sent = docs.sparkSession.sparkContext.broadcast((language, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, mixer = sent.value
        base, reader = language.log10(language.counts), Reader(language.numbers)
        for batch in portions(batches, "text", 1 << 12, PORTION):
            texts = batch.column("text").to_pylist()
            tokens, known, size = ([0] * len(texts) for _ in range(3))
            base_score, score = [0.0] * len(texts), [0.0] * len(texts)
            rare: list[Counter[str]] = [Counter() for _ in texts]
            own = np.zeros((1, WORD_CONTEXTS), np.float32)
            for group in stretches(texts):
                symbols, contexts, sizes, words = reader.read(group)
                at, n, contexts, held = mixer.code.blocks(symbols, contexts, sizes)
                x, gate, bit = mixer.inputs(at, n, contexts)
                ends, whole = np.cumsum(sizes), -(-held // BLOCK) * BLOCK
                begin = np.cumsum(whole) - whole
                for a, b in zip((begin + held).tolist(), (begin + whole).tolist()):
                    x[:, a:b] = 0
                carried = np.zeros((len(group), WORD_CONTEXTS), np.float32)
                if not group[0][2]:
                    carried[0] = own
                chances = np.empty((len(at) // BLOCK, BLOCK), np.float32)
                z = adapted(x, mixer.sums(x, gate), bit, whole, carried, chances)
                own = carried[-1]
                logs = mixer.log10(z, gate, bit, chances.reshape(-1))
                for a, b in zip((begin + held).tolist(), (begin + whole).tolist()):
                    logs[a:b] = 0
                logs = np.add.reduceat(logs, begin, dtype=float)
                is_rare = symbols == ESCAPE
                common = np.concatenate(([0.0], np.cumsum(np.where(is_rare, 0.0, base[symbols]))))
                learned = np.concatenate(([0], np.cumsum(~is_rare & (language.counts[symbols] > 0))))
                for i, (row, own_words, _, _) in enumerate(group):
                    a, b = int(ends[i] - sizes[i]), int(ends[i])
                    tokens[row] += b - a
                    known[row] += int(learned[b] - learned[a])
                    base_score[row] += float(common[b] - common[a])
                    score[row] += float(logs[i])
                    size[row] += sum(map(len, own_words)) + b - a
                    rare[row].update(map(bytes.decode, words[i]))
            pairs = pa.StructArray.from_arrays([pa.array([w for c in rare for w in c], pa.string()), pa.array([k for c in rare for k in c.values()], pa.int64())], ["word", "times"])
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, pa.int64()) for c in (tokens, known)), *(pa.array(c, pa.float64()) for c in (base_score, score)), pa.array(size, pa.int64()), listed],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.col("part") == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, SCORED)


def scored(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold(FOLDS).alias("part"))
    counts = stored(vocabulary(docs), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    ends = sum(r.n for r in counts.where("word = ''").select("n").collect())
    frequent = common_words(counts, common)
    numbers = Lookup(w.encode() for w, _ in frequent)
    at = np.array([ends, 0, *(n for _, n in frequent)], np.int64)
    language = Language(numbers, at, tokens, distinct)
    escaped = max(1, tokens - int(at.sum()))
    words = learn_words(docs, numbers, Code.of([max(1, ends), escaped, *(n for _, n in frequent)]))

    least = min((n for _, n in frequent), default=None)
    rare = counts.where("word <> ''")
    rare = rare.where(F.col("n") < least) if least is not None else rare
    letters = np.bincount(np.frombuffer("".join(w for w, _ in frequent).encode(), np.uint8), minlength=256) + 1
    spelling_code = Code.of([*letters.tolist(), len(frequent) + 1])
    spellings = stored(spelt(rare, learn_spelling(rare, spelling_code)), "spellings")

    found = stored(scored_words(docs, language, words), "scored-words")
    base = F.log10((F.col("n") + SMOOTHING) / F.lit(tokens + SMOOTHING * (distinct + 1)))
    held = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(spellings, "word")
    held = held.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * base).alias("_base"), F.sum(F.col("times") * F.col("spelt")).alias("_spelt")
    )
    out = found.drop("rare").join(held, "row", "left")
    score = F.col("score") + F.coalesce("_spelt", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / (math.log10(2) * F.col("n_bytes"))).alias("bits_per_byte"),
    )


def op13_lm_scoring(spark, sf_dir):
    from .shared import table

    return scored(table(spark, sf_dir, "documents"))
