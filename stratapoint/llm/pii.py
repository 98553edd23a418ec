"""Personal data by candidate gradient boosting.

Generators of high recall propose spans that may overlap: the base patterns, looser forms of each
kind (an address with "(at)", a card with dots, a phone without its plus) and, as a kind of their own,
secrets: long runs of letters and digits. Each candidate has features of its format, its checks and its
context. Boosted trees, one ensemble for each kind, decide which of them are added to the base spans.

Nothing is labelled by hand. The trees learn from a bounded sample of documents (about `train_docs`):

* base spans that passed their checks are right, and so are rewritten copies of them in the same place
  (another separator, no plus, "(at)" for the @);
* loose candidates off the base spans that fail the kind's check are wrong, and so are spoilt copies of
  base spans (a digit changed so that the checksum fails, a part over 255, years or thousands in place of a phone);
* a secret is right where a word such as "token" or "password" is assigned it, and wrong where nothing is; spoilt
  copies are runs of one case of letters, of digits, or of a word repeated. Other candidates teach nothing.

Each kind's margins are calibrated to probabilities on rows that their trees have not seen (cross-fitting over
three folds of documents), and its threshold is the lowest probability, one half at least, from which on a
share `precision` of those rows was right; a kind for which there is none adds nothing. Of the candidates
over the threshold the most probable that touch no base span and no other added span are added. Base spans always stay.

A null or empty text has no spans. Repeated rows are each searched. An empty table gives an empty result,
and without base spans or assigned secrets to learn from only base spans are found. All columns of the input stay.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import slices, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in the order in which they are listed.
ALL_KINDS = (*KINDS, "secret")
#: Fixed patterns of the base spans.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[\w-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]{1,63}){1,4}"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![\w.]*[0-9])"),
    "card": re.compile(r"(?<![\w+])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{4}){2,3}(?:[\x20._/-]{0,2}[0-9]{1,4})?(?!\w)"),
    "phone": re.compile(r"(?<![\w.+])(?:[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?!\w)"),
    "secret": re.compile(r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*+[0-9])[\w+/=-]{16,}+", re.ASCII),
}
#: The same matches as BASE["ip"]: a match begins and ends where a run of digits does, so no shorter run need be tried.
FAST_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
MARK = re.compile(r"[@0-9]|[(\[{]at[)\]}]").search
#: The characters of an address before its @.
LETTERS = string.digits + string.ascii_letters + "._%+-"
ASSIGNED = re.compile(r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|auth|credential)\w*\W{0,2}\s?[:=]\s?\W?$").search

TRAIN_DOCS = 20_000
PRECISION = 0.95
ROUNDS, DEPTH, RATE, BINS = 30, 3, 0.3, 16
FOLDS = 3
CONTEXT = 48

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(span: str) -> str:
    return re.sub("[^0-9]", "", span)


def passes(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    digits = digits_of(span)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_emails(text: str) -> list[Span]:
    """What the email pattern finds from left to right, sought from each @ backwards: no run without an @ is tried at every place."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        near = max(end, at - 4096)
        start = near + len(text[near:at].rstrip(LETTERS))
        if start == near > end:  # a longer run than looked at
            start = end + len(text[end:at].rstrip(LETTERS))
        found = BASE["email"].match(text, start) if start < at else None
        if found:
            out.append(found.span())
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> dict[str, list[Span]]:
    text = text or ""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not MARK(text):
        return out
    out["email"] = base_emails(text)
    for kind in KINDS[1:]:
        find_all = FAST_IP if kind == "ip" else BASE[kind]
        out[kind] = [m.span() for m in find_all.finditer(text) if passes(kind, m[0])]
    return out


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """What the generators propose, sorted."""
    if not text or not MARK(text):
        return []
    found = {(k, *m.span()) for k in ALL_KINDS for m in LOOSE[k].finditer(text)}
    found |= {(k, *m.span()) for k in KINDS if k != "email" for m in (FAST_IP if k == "ip" else BASE[k]).finditer(text) if m.end() - m.start() > 6}
    return sorted(found)


class Taken:
    """Places of a text that spans lie on, as disjoint intervals in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touch(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that touches none of the others."""
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


#: Context words count by a hash, in so many buckets on each side.
WORD_BUCKETS = 16


def features(before: str, span: str, after: str) -> list[float]:
    """Of a span and the text on both sides of it."""
    n = len(span)
    digits = digits_of(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    counts = Counter(span)
    share = np.array(list(counts.values())) / n
    words = [re.findall(r"\w+", before)[-1:], re.findall(r"\w+", after)[:1]]
    sides = [[0.0] * WORD_BUCKETS for _ in words]
    for side, word in zip(sides, words):
        if word:
            side[hashlib.md5(word[0].lower().encode()).digest()[0] % WORD_BUCKETS] = 1.0
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    last, first = before[-1:], after[:1]
    return [
        n, len(digits), len(digits) / n, len(groups), *(groups + [0] * 5)[:5], max(groups, default=0), min(groups, default=0),
        sum(map(str.islower, span)), sum(map(str.isupper, span)), span.count("."), span.count("-"), span.count(" "), span.count("("), span.count("@"),
        float("at" in span), float(span[0] == "+" or last == "+"), float(span[0] == "0"),
        float(-(share * np.log2(share)).sum()), len(counts) / n, sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        float(len(digits) >= 12 and luhn(digits)), float(max((len(p) > 3 or int(p) > 255 for p in parts), default=False)),
        float(last in ('"', "'")), float(first in ('"', "'")), float("=" in before[-4:]), float(":" in before[-4:]),
        float(not last or last.isspace()), float(last.isalnum()), float(not first or first.isspace()), float(first.isalnum()), *sides[0], *sides[1],
    ]


def sides(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def rewritten(kind: str, span: str) -> list[str]:
    """Other ways to write what the span says."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} @ {host}"]
    if kind == "ip":
        return [span.replace(".", " . "), span.replace(".", ". ")]
    digits = digits_of(span)
    if kind == "card":
        return [sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sign in (".", "/", "  ")]
    if kind == "phone":
        if len(digits) < 10:
            return [f"{digits[:3]}-{digits[3:6]}{digits[6:]}"]
        head, (a, b, c) = digits[:-10], (digits[-10:-7], digits[-7:-4], digits[-4:])
        return [f"{head} ({a}) {b}-{c}".strip(), f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}/{b}-{c}"]
    return [span.strip("\"'"), span.upper(), span[:24]]


def spoilt(kind: str, span: str, draw: int) -> list[str]:
    """What looks like the span and is not of its kind."""
    digits = digits_of(span)
    if kind == "ip":
        parts = span.split(".")
        parts[draw % 4] = str(256 + draw % 700)
        return [".".join(parts), " . ".join(parts)]
    if kind == "card":
        other = digits[:-1] + str((int(digits[-1]) + 1 + draw % 9) % 10)
        return [other, ".".join(other[i : i + 4] for i in range(0, len(other), 4))]
    if kind == "phone":
        year = 1900 + draw % 120
        thousands = f"{draw % 9999 + 1:,}.{draw * 7 % 1000:03d}.{draw % 3 * 500:03d}".replace(",", "")
        return [f"{year}-{year + 5} {year + 9}", thousands, f"{year} {year + 1} {year + 2}", f"{draw % 100}.{draw % 997:03d}-{draw % 991:03d}"]
    if kind == "secret":
        word = "abcdefghijklmnop"[draw % 9 :][:7]
        return [f"{draw % 10**9:09d}" * 3, f"{word}-{draw % 99}-" + f"{word}-" * 3, f"{word}{draw % 9}" * 4]
    name, _, host = span.partition("@")
    return [f"{name}@{draw % 9}.{draw % 7}", f"{host} @ {draw % 100}.50"]


@dataclass
class Boosted:
    """Trees as rows (feature, threshold, left, right, value), feature -1 in leaves; a sum of values from `start` is a log-odds."""

    start: float = 0.0
    trees: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f, t, lo, hi, _v = tree[at].T
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0).astype(int)] <= t
                at = np.where(inner, np.where(go, lo, hi), at).astype(int)
            out += tree[at, 4]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Logistic gradient boosting with Newton leaves, split by histograms over quantiles."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(share / (1 - share))))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1) + np.arange(width) * (BINS + 1)
    f = np.full(len(y), model.start)

    def sums(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of each feature's values up to each cut."""
        flat = np.bincount(binned[rows].ravel(), np.repeat(of[rows], width), width * (BINS + 1))
        return np.cumsum(flat.reshape(width, BINS + 1), axis=1)[:, :-1]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            total, weight = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0, 0, 0, RATE * total / (weight + 1.0)])
            if depth == DEPTH or len(rows) < 2:
                return at
            a, b, n = sums(rows, g), sums(rows, h), sums(rows, np.ones(len(y)))
            gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
            gain[(n == 0) | (n == len(rows))] = 0.0
            j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, cut] > 1e-3 and cut < len(cuts[j]):
                t = float(cuts[j][cut])
                m = x[rows, j] <= t
                left, right = add(rows[m], depth + 1), add(rows[~m], depth + 1)
                nodes[at] = [j, t, left, right, 0]
            return at

        add(np.arange(len(y)), 0)
        model.trees.append(np.array(nodes, float))
        f = f + Boosted(0.0, model.trees[-1:]).margin(x)
    return model


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins log-odds, by a few Newton steps on smoothed labels."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margin, np.ones(len(y))])
    w = np.array([1.0, 0.0])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
    return float(max(w[0], 1e-3)), float(w[1])


def probability(margin: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -30, 30)))


@dataclass
class SpanModel:
    """Trees, calibration and least probability of each kind that has them."""

    models: dict[str, Boosted]
    scales: dict[str, tuple[float, float]]
    thresholds: dict[str, float]

    def added(self, texts: list[str | None], bases: list[dict[str, list[Span]]]) -> list[list[tuple[str, int, int, float]]]:
        """kind, start, end and probability of what each text's base spans lack. The texts' candidates are scored together."""
        taken = [Taken([s for spans in base.values() for s in spans]) for base in bases]
        found: dict[str, list[tuple[int, int, int]]] = {k: [] for k in self.thresholds}
        for i, text in enumerate(texts):
            for kind, start, end in candidates(text):
                if kind in found and not taken[i].touch(start, end):
                    found[kind].append((i, start, end))
        good: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        for kind, places in found.items():
            for a in range(0, len(places), 4096):
                part = places[a : a + 4096]
                x = np.array([features(*sides(texts[i], start, end)) for i, start, end in part])
                p = probability(self.models[kind].margin(x), self.scales[kind])
                for (i, start, end), score in zip(part, p.tolist()):
                    if score >= self.thresholds[kind]:
                        good[i].append((-score, ALL_KINDS.index(kind), start, end))
        out: list[list[tuple[str, int, int, float]]] = []
        for i, rows in enumerate(good):
            out.append([])
            for score, k, start, end in sorted(rows):
                if not taken[i].touch(start, end):
                    taken[i].add(start, end)
                    out[i].append((ALL_KINDS[k], start, end, -score))
        return out


def lessons(text: str | None, key: int) -> list[tuple[str, bool, list[float]]]:
    """kind, right and features of what a text teaches. key: a number of the text, which draws the copies."""
    base = base_spans(text)
    taken = Taken([s for spans in base.values() for s in spans])
    seen: list[tuple[str, bool, str, str, str]] = []
    for kind, start, end in candidates(text):
        before, span, after = sides(text, start, end)
        if kind == "secret":
            if ASSIGNED(before):
                seen.append((kind, True, before, span, after))
            elif not re.search("[:=]", before[-4:]):
                seen.append((kind, False, before, span, after))
        elif not taken.touch(start, end):
            plain = re.sub(r"\x20", "", span) if kind == "ip" else span
            if kind in ("ip", "card") and not passes(kind, plain):
                seen.append((kind, False, before, span, after))
    seen += [(kind, True, *sides(text, start, end)) for kind in KINDS for start, end in base[kind]]
    out = []
    for kind, right, before, span, after in seen:
        out.append((kind, right, features(before, span, after)))
        if right:
            others, wrong = rewritten(kind, span), spoilt(kind, span, key)
            out += [(kind, True, features(before, other, after)) for other in others]
            bare = re.sub(r"[\w\"':= ]*$", "", before) if kind == "secret" else before  # without what assigns it
            out += [(kind, False, features(bare, other, after)) for other in wrong]
    return out


def fitted(rows: list[tuple[str, bool, int, list[float]]], precision: float) -> SpanModel:
    """rows: kind, right, fold, features."""
    model = SpanModel({}, {}, {})
    for kind in ALL_KINDS:
        own = [r for r in rows if r[0] == kind]
        if len(own) < 8:
            continue
        x, y, at = np.array([r[3] for r in own], float), np.array([r[1] for r in own], float), np.array([r[2] for r in own])
        margin = np.full(len(y), np.nan)
        for k in range(FOLDS):
            rest = at != k
            if (at == k).any() and 0 < y[rest].sum() < rest.sum():
                margin[at == k] = boost(x[rest], y[rest]).margin(x[at == k])
        held = ~np.isnan(margin)
        if not 0 < y[held].sum() < held.sum():
            continue
        scale = calibration(margin[held], y[held])
        p, right = probability(margin[held], scale), y[held]
        order = np.argsort(-p, kind="stable")
        p, share = p[order], np.cumsum(right[order]) / (1 + np.arange(len(p)))
        last = np.append(p[1:] != p[:-1], True)  # equal scores stand or fall together
        good = np.flatnonzero((share >= precision) & last & (p >= 0.5))
        if len(good):
            model.models[kind], model.scales[kind], model.thresholds[kind] = boost(x, y), scale, float(p[good[-1]])
    return model


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> SpanModel:
    """A model from at most about train_docs documents with something to propose, drawn by a hash of doc_id and text.

    Of each kind about train_docs / 4 lessons, also drawn by a hash, go to the driver, which fits the trees.
    """
    marked = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(29)).alias("key"), "text").where(F.col("text").rlike(MARK.__self__.pattern))
    total = marked.count()
    if not total:
        return SpanModel({}, {}, {})
    share = min(1.0, train_docs / total)
    sample = marked.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["key"])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fold = (key >> 24) % FOLDS
                out += [(kind, right, fold, x, key, i) for i, (kind, right, x) in enumerate(lessons(text, (key >> 30) % 1_000_003))]
            columns = zip(*out) if out else ([], [], [], [], [], [])
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["kind", "right", "fold", "x", "key", "i"])

    rows = stored(sample.mapInArrow(teach, "kind string, right boolean, fold int, x array<double>, key long, i int"), "span-lessons")
    part = F.lit(0.0)
    for r in rows.groupBy("kind").count().collect():
        part = F.when(F.col("kind") == r["kind"], F.lit(min(1.0, train_docs / 4 / r["count"]))).otherwise(part)
    own = F.pmod(F.xxhash64("key", "i", F.lit(3)), F.lit(1 << 20))
    drawn = sorted(tuple(r) for r in rows.where(own < part * (1 << 20)).select("kind", "right", "fold", "x").collect())
    return fitted(drawn, precision)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find(docs: DataFrame, model: SpanModel, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with the spans of personal data: kind, start and end in code points, and whether it is a base span."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred tree nodes
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            bases = [base_spans(t) for t in texts]
            rows = []
            for base, added in zip(bases, sent.value.added(texts, bases)):
                spans = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(k, a, b, False) for k, a, b, _ in added]
                spans.sort(key=lambda s: (ALL_KINDS.index(s[0]), s[1]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(SPAN))]))


def redact(found: DataFrame, text: str = "text", spans: str = "spans", out: str = "redacted") -> DataFrame:
    """What find returned with a column in which each span, or spans that overlap, is the kind of the first in brackets."""
    found = found.drop(out)

    def masked(t: str | None, own: list[dict]) -> str | None:
        parts, end = [], 0
        for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= end:
                parts += [t[end : s["start"]], f"[{s['kind']}]"]
            end = max(end, s["end"])
        return t if not own else "".join([*parts, t[end:]])

    def run(batches):
        for batch in slices(batches):
            new = [masked(t, s or []) for t, s in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, out])

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField(out, T.StringType())]))


def op10_pii(spark, sf_dir):
    """Base counts by kind; the number of secrets, of all spans and of those added; the spans themselves."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs)).drop("text")

    def joined(spans: str):
        return F.concat_ws(",", F.transform(F.expr(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = "filter(spans, s -> s.base)"
    return found.select(
        "doc_id",
        *(F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.expr("size(filter(spans, s -> s.kind = 'secret'))").cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_found"),
        F.expr("size(filter(spans, s -> NOT s.base))").cast("long").alias("n_added"),
    )
