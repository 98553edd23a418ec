"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors become one node, named by a 64-bit hash. Nodes fall into bands by their norm, each half as long
as the one before, counted from the largest; in its band a vector is scaled to a norm of one at most and lengthened by one
coordinate that makes all norms one, so that the nodes of largest inner product are also the closest. A few
vectors of enormous length thus have a band of their own and blur no others. First neighbours come from small groups of nodes
of a band that fall on the same sides of random hyperplanes. Then rounds of NN-descent, each a few Spark joins, until one
changes hardly a list entry: every node gathers its neighbours and a sample of the nodes it is a
neighbour of, compares those that are new with all, and tells each the better ones it has found.

Nodes lie in buckets by their name, and what one bucket has to tell another is one packed row, in which a vector stands once however
many centers need it; inside a bucket all is arrays. So the rows of a join grow with the pairs of buckets, not with those of nodes.

A search starts at the query's own node and goes on through the neighbours of the best nodes so far, all
queries at once, one join for each step, until the best `beam` nodes have all been looked at. What it looks into, each node's
neighbours with their vectors, is laid out by buckets once and read by every step without a shuffle. Other bands whose
longest vector could still beat the `count` best so far (the norm bounds the product) are then searched from sampled entry
nodes. The best nodes found are scored once more in double precision on the original vectors.

The graph is approximate by design (k neighbours, sampled reverse neighbours), and how wide a search must be depends on the vectors and grows with the table. So every run
measures itself: about CHECKED queries are compared with all vectors in one scan, and while the searches have found less than TARGET of what is
nearest to these, all are searched again with WIDER times the beam, up to the whole table. The share reached is told in the log. Vectors that are null or zero or hold null or non-finite
components take no part, nor do those of another length than most (of lengths equally frequent the shortest counts).
Repeated vec_ids are separate candidates, except for a query of the same vec_id. Fewer rows than asked for give
all candidates found. An empty table gives an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import bucketed, forget, slices, stored

NEIGHBOURS, REVERSE = 32, 16
#: Reverse neighbours that a search follows, at most.
FOLLOWED = 40
#: Queries whose nearest are sought among all vectors, about; the share that searches must reach of them; how much wider they become if not.
CHECKED, TARGET, WIDER = 64, 0.95, 4
#: Rounds end once a round changes no more than this share of the list entries.
CHANGED = 0.01
#: Hyperplane trees, and nodes of a group, about.
TREES, GROUP = 8, 512
#: Vectors on which the hyperplanes' positions are chosen, about, and entry nodes of a band.
SAMPLE_ROWS, ENTRIES = 16_384, 256
#: Nodes a search keeps, and nodes it looks at in a step.
BEAM, WIDTH = 1024, 384
#: Nodes of a bucket, at most about; tables of fewer than BUCKET * BUCKETS nodes get buckets of SMALL nodes at least and as many as BUCKETS.
BUCKET, BUCKETS, SMALL = 16_384, 64, 128
#: List entries of the queries of one bucket, about.
ENTRIES_HELD = 1 << 19
#: Centers compared at a time, and better pairs held before only the best of each node are kept.
CENTERS, PAIRS = 512, 4_000_000

log = logging.getLogger(__name__)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    return out.where("x IS NOT NULL AND vec_id IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(x, v -> v <> 0)")


def matrix(column: pa.Array | pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, pd.Series) else column.to_pylist()), kind).reshape(-1, width).astype(np.float32)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scored ids, each once, ties to the smaller."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def first_of_pairs(a: np.ndarray, b: np.ndarray, later: np.ndarray | None = None) -> np.ndarray:
    """The place of one of each distinct pair, by a 64-bit hash of both; of equal ones the first that is not `later`."""
    key = hashed(a, b)
    if later is not None:
        key = key & ~np.uint64(1) | later.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order] >> np.uint64(1)
    return order[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]


def best_rows(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, known: np.ndarray | None = None) -> np.ndarray:
    """Places of the k highest scored ids of each group (numbers below 2^31), each once (as it is known, if it is), by group and best first."""
    once = first_of_pairs(group, ids, None if known is None else ~known)
    bits = (-scores[once] + np.float32(0)).astype(np.float32).view(np.uint32)  # falling scores, as whole numbers that rise
    rising = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    once = once[np.argsort(group[once].astype(np.uint64) << np.uint64(32) | rising, kind="stable")]
    return once[places(group[once]) < k]


def places(sorted_groups: np.ndarray) -> np.ndarray:
    """The place of each entry in its group."""
    n = len(sorted_groups)
    begins = np.concatenate([np.zeros(min(1, n), np.int64), np.flatnonzero(sorted_groups[1:] != sorted_groups[:-1]) + 1])
    return np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))


def hashed(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs."""
    m = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = (m ^ (m >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (b.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return m ^ (m >> np.uint64(32))


def joined(column: pa.Array | pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, pd.Series) else column.to_pylist()), kind)


def rows_for(to: np.ndarray, source: int, **columns: np.ndarray) -> dict[str, list]:
    """One row for each bucket in to: all that goes there, packed."""
    order = np.argsort(to, kind="stable")
    found, begin = np.unique(to[order], return_index=True)
    out = {"to": found.tolist(), "source": [source] * len(found)}
    for name, values in columns.items():
        out[name] = [part.tobytes() for part in np.split(values[order], begin[1:])] if len(found) else []
    return out


def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c in ("to", "source") else pa.binary()) for c, v in rows.items()], list(rows))


def floats(column: pa.Array, dims: int) -> np.ndarray:
    """A column of arrays of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


#: A bucket of nodes: their names in order, vectors in half precision, and for each the k best so far; entries of score minus infinity are empty.
GRAPH = "bucket long, node binary, v binary, ids binary, scores binary, fresh binary"
#: For a bucket: nodes and what may belong in their lists, as many ids for each node of a row.
BETTER = "to long, source long, node binary, ids binary, scores binary"
#: For a bucket of centers: which members each has, and the members' names, vectors and worst scores; index tells a member's place among these.
AROUND = "to long, source long, center binary, index binary, fresh binary, ids binary, v binary, worst binary"


def packed(nodes: DataFrame, k: int, buckets: int) -> DataFrame:
    """The graph without an edge."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        n = len(pdf)
        row = (pdf["node"].to_numpy().tobytes(), b"".join(pdf["v"]), bytes(8 * n * k), np.full(n * k, -np.inf, "f4").tobytes(), bytes(n * k))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *row)], columns=["bucket", "node", "v", "ids", "scores", "fresh"])

    return nodes.select(F.pmod("node", F.lit(buckets)).alias("bucket"), "node", "v").groupBy("bucket").applyInPandas(pack, GRAPH)


def merged(graph: DataFrame, better: DataFrame, k: int) -> DataFrame:
    """The graph with the k best of what it has and of what is better; entries that it had not are fresh."""

    def merge(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        node, had, score = joined(own["node"], "i8"), joined(own["ids"], "i8").reshape(-1, k), joined(own["scores"], "f4").reshape(-1, k)
        full = score > -np.inf
        names = [np.frombuffer(b, "i8") for b in told["node"]]
        at = [np.repeat(n, len(i) // 8 // max(1, len(n))) for n, i in zip(names, told["ids"])]
        at = np.concatenate([np.nonzero(full)[0], np.searchsorted(node, np.concatenate([np.zeros(0, np.int64), *at]))])
        ids, scores = np.concatenate([had[full], joined(told["ids"], "i8")]), np.concatenate([score[full], joined(told["scores"], "f4")])
        known = np.arange(len(at)) < full.sum()
        keep = best_rows(at, ids, scores, k, known)
        place = (at[keep], places(at[keep]))
        new = np.zeros((len(node), k), "i8"), np.full((len(node), k), -np.inf, "f4"), np.zeros((len(node), k), bool)
        for column, values in zip(new, (ids, scores, ~known)):
            column[place] = values[keep]
        return own.assign(**{c: [values.tobytes()] for c, values in zip(("ids", "scores", "fresh"), new)})

    return graph.groupBy("bucket").cogroup(better.groupBy("to")).applyInPandas(merge, GRAPH)


def drawn(column, share: float, seed: int):
    """A condition that holds for such a share of the column's values."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)) if share < 1 else F.lit(True)


def first_neighbours(nodes: DataFrame, totals: dict[int, int], width: int, k: int, trees: int, group: int, sample_rows: int, buckets: int) -> DataFrame:
    """nodes: node, band, v (half-precision floats). The k best of each node within its groups. totals: the nodes of each band."""
    total = sum(totals.values())
    sample = nodes.where(drawn("node", sample_rows / max(1, total), 5)).select("band", "v").collect()  # about sample_rows rows, whatever the total
    points = np.frombuffer(b"".join(bytes(r.v) for r in sample), "f2").reshape(-1, width).astype(np.float32)
    bands = np.array([r.band for r in sample], np.int64)
    masks = {band: (1 << max(0, int(np.ceil(np.log2(max(1.0, n / group)))))) - 1 for band, n in totals.items()}
    planes = max(masks.values(), default=0).bit_length()
    rng = np.random.default_rng(13)
    normals = rng.standard_normal((trees, width, planes)).astype(np.float32)
    at = [np.median(points @ n, axis=0) if len(points) else np.zeros(planes) for n in normals]
    powers = 1 << np.arange(planes)

    def codes(x: np.ndarray, band: np.ndarray, normals: np.ndarray, at: np.ndarray) -> np.ndarray:
        side = (x @ normals > at) @ powers if planes else np.zeros(len(x), int)
        return side.astype(np.int64) & np.array([masks[b] for b in band.tolist()], np.int64)

    chunks = []
    for n, m in zip(normals, at):  # a side that holds more than its share, near copies of one vector say, is cut at random
        pairs, count = np.unique(np.stack([bands, codes(points, bands, n, m)]), axis=1, return_counts=True)
        chunks.append({(int(b), int(c)): max(1, round(int(x) / max(1, len(points)) * total / group)) for b, c, x in zip(*pairs, count)})
    sent = nodes.sparkSession.sparkContext.broadcast((normals, at, chunks))  # no larger than the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, at, chunks = sent.value
        for batch in slices(batches, 4096):
            x, ids, band = matrix(batch.column("v"), "f2", width), batch.column("node").to_numpy(), batch.column("band").to_numpy()
            for t in range(trees):
                code = codes(x, band, normals[t], at[t])
                pieces = np.array([chunks[t].get(c, 1) for c in zip(band.tolist(), code.tolist())], np.int64)
                piece = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * t)) >> np.uint64(33)).astype(np.int64) % pieces
                columns = [pa.array(np.full(len(x), t)), batch.column("band"), pa.array(code), pa.array(piece), batch.column("node"), batch.column("v")]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "band", "code", "piece", "node", "v"])

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {c: pdf[c].to_numpy() for c in ("tree", "band", "code", "piece")}
        order = np.lexsort(tuple(own.values()))
        changes = np.flatnonzero(np.any([v[order][1:] != v[order][:-1] for v in own.values()], axis=0)) + 1
        all_x, all_ids = matrix(pdf["v"], "f2", width), pdf["node"].to_numpy()
        found: dict[int, list] = {}  # by the number of neighbours
        for rows in np.split(order, changes):
            x, ids, n = all_x[rows], all_ids[rows], min(k, len(rows) - 1)
            for a in range(0, len(x) if n else 0, 1024):
                s = x[a : a + 1024] @ x.T
                s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                found.setdefault(n, []).append((ids[a : a + 1024], ids[top], np.take_along_axis(s, top, 1)))
        out = [pd.DataFrame(columns=["to", "source", "node", "ids", "scores"])]
        for parts in found.values():
            node, ids, scores = (np.concatenate(c) for c in zip(*parts))
            out.append(pd.DataFrame(rows_for(node % buckets, -1, node=node, ids=ids, scores=scores)))
        return pd.concat(out[1:] or out)

    placed = nodes.select("node", "band", "v").mapInArrow(place, "tree long, band long, code long, piece long, node long, v binary")
    held = F.pmod(F.xxhash64("tree", "band", "code", "piece"), F.lit(max(1, -(-trees * total // BUCKET), min(BUCKETS, trees * total // (2 * group)))))
    return placed.groupBy(held.alias("_groups")).applyInPandas(nearest, BETTER)


def gathered(graph: DataFrame, k: int, reverse: int, buckets: int, draw: int = 0, fresh_only: bool = False) -> DataFrame:
    """Each node as a center with its neighbours and up to `reverse` nodes drawn from those it is a neighbour of, and with their vectors.
    fresh_only: only centers with a fresh member, and each is a member of its own."""

    def edges(batches):
        for batch in batches:
            for bucket, node, ids, scores, fresh in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "ids", "scores", "fresh"))):
                node, ids, fresh = np.frombuffer(node, "i8"), np.frombuffer(ids, "i8"), np.frombuffer(fresh, bool)
                at = np.flatnonzero(np.frombuffer(scores, "f4") > -np.inf)
                yield batch_of(rows_for(ids[at] % buckets, bucket, center=node[at // k], member=ids[at], fresh=fresh[at]))

    def choose(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        node, ids, own_fresh = joined(own["node"], "i8"), joined(own["ids"], "i8"), joined(own["fresh"], bool)
        at = np.flatnonzero(joined(own["scores"], "f4") > -np.inf)
        back, here, fresh = joined(told["center"], "i8"), joined(told["member"], "i8"), joined(told["fresh"], bool)
        here = np.searchsorted(node, here)
        chance = hashed(back, here, draw) >> np.uint64(33) | (~fresh).astype(np.uint64) << np.uint64(31)
        order = np.argsort(here.astype(np.uint64) << np.uint64(32) | chance, kind="stable")
        order = order[places(here[order]) < reverse]
        center = np.concatenate([at // k, here[order]])
        member, fresh = np.concatenate([ids[at], back[order]]), np.concatenate([own_fresh[at], fresh[order]])
        if fresh_only:
            news = np.zeros(len(node), bool)
            news[center[fresh]] = True
            keep, alone = news[center], np.flatnonzero(news)
            center, member, fresh = np.concatenate([center[keep], alone]), np.concatenate([member[keep], node[alone]]), np.concatenate([fresh[keep], np.zeros(len(alone), bool)])
        order = first_of_pairs(center, member, ~fresh)
        return pd.DataFrame(rows_for(member[order] % buckets, int(own["bucket"].iloc[0]), center=node[center[order]], member=member[order], fresh=fresh[order]))

    def bring(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        node, v = joined(own["node"], "i8"), joined(own["v"], "u1").reshape(len(joined(own["node"], "i8")), -1)
        worst = joined(own["scores"], "f4").reshape(-1, k).min(axis=1)
        out = []
        for source, center, member, fresh in zip(*(asked[c] for c in ("source", "center", "member", "fresh"))):
            ids, index = np.unique(np.frombuffer(member, "i8"), return_inverse=True)
            at = np.searchsorted(node, ids)
            out.append((source, asked["to"].iloc[0], center, index.astype("i4").tobytes(), fresh, ids.tobytes(), v[at].tobytes(), worst[at].tobytes()))
        return pd.DataFrame(out, columns=["to", "source", "center", "index", "fresh", "ids", "v", "worst"])

    pairs = "to long, source long, center binary, member binary, fresh binary"
    told = graph.select("bucket", "node", "ids", "scores", "fresh").mapInArrow(edges, pairs)
    asked = graph.select("bucket", "node", "ids", "scores", "fresh").groupBy("bucket").cogroup(told.groupBy("to")).applyInPandas(choose, pairs)
    return graph.select("bucket", "node", "v", "scores").groupBy("bucket").cogroup(asked.groupBy("to")).applyInPandas(bring, AROUND)


def around(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Of one bucket of centers: centers, in order, each with as many members as the next array tells; these members' places and whether they are fresh; names and vectors of all members."""
    ids, v = joined(rows["ids"], "i8"), matrix(rows["v"], "f2", width)
    offset = np.cumsum([0, *(len(i) // 8 for i in rows["ids"])])[:-1]
    index = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(i, "i4") + o for i, o in zip(rows["index"], offset))])
    center = joined(rows["center"], "i8")
    order = np.argsort(center, kind="stable")
    names, count = np.unique(center, return_counts=True)
    return names, count, index[order], joined(rows["fresh"], bool)[order], ids, v


def descend(graph: DataFrame, width: int, k: int, reverse: int, buckets: int, draw: int = 0) -> DataFrame:
    """One round: the graph with what its nodes' neighbours know of each other, where that is news."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        centers, count, index, fresh, ids, x = around(rows, width)
        worst = joined(rows["worst"], "f4")
        most = int(count.max(initial=0))
        at = np.repeat(np.arange(len(centers)), count), places(np.repeat(np.arange(len(centers)), count))
        member, new, there = np.zeros((len(centers), most), np.int64), np.zeros((len(centers), most), bool), np.zeros((len(centers), most), bool)
        member[at], new[at], there[at] = index, fresh, True
        others = ~np.eye(most, dtype=bool)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        held = 0
        for a in range(0, len(centers), CENTERS):
            m, n, t = (c[a : a + CENTERS] for c in (member, new, there))
            near = x[m]
            s = near @ near.transpose(0, 2, 1)
            better = (s > worst[m][:, :, None]) & (n[:, :, None] | n[:, None, :]) & t[:, :, None] & t[:, None, :] & others
            c, i, j = np.nonzero(better)
            found.append((m[c, i], m[c, j], s[c, i, j]))
            held += len(c)
            if held > PAIRS or a + CENTERS >= len(centers):
                node, other, score = (np.concatenate(f) for f in zip(*found))
                keep = best_rows(node, other, score, k)
                found, held = [(node[keep], other[keep], score[keep])], 0
        node, other, score = found[0]
        return pd.DataFrame(rows_for(ids[node] % buckets, int(rows["to"].iloc[0]), node=ids[node], ids=ids[other], scores=score))

    return merged(graph, gathered(graph, k, reverse, buckets, draw, fresh_only=True).groupBy("to").applyInPandas(compare, BETTER), k)


def share_changed(graph: DataFrame) -> float:
    """Share of the list entries that the last round brought."""

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(joined(batch.column("fresh"), bool).sum())]), pa.array([int((joined(batch.column("scores"), "f4") > -np.inf).sum())])], ["new", "held"])

    new, held = graph.select("fresh", "scores").mapInArrow(counted, "new long, held long").agg(F.sum("new"), F.sum("held")).first()
    return (new or 0) / max(1, held or 0)


#: A bucket of queries: node, band and vector (single precision) of each, how many nodes its list has, and all lists, best first, with what has been looked at. open: some list is not.
SEARCH = "bucket long, node binary, band binary, v binary, sizes binary, ids binary, scores binary, seen binary, open int"
#: What a bucket of queries asks a bucket of nodes: queries, their vectors and what a node must beat to be among their best so far; at, the place of a query in these, and the node it looks at.
ASKED = "to long, source long, query binary, v binary, floor binary, at binary, node binary"
FOUND = "to long, source long, query binary, ids binary, scores binary"


def search(begun: DataFrame, queries: int, links: DataFrame, buckets: int, width: int, beam: int, expand: int, kept: int) -> DataFrame:
    """begun: node, band, v (single precision), ids and scores to begin with, best first, about so many queries. links: what `gathered` gives. Returns node, band, and ids and scores of the `kept` best."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["ids"].map(len).to_numpy("i4")
        row = (pdf["node"].to_numpy().tobytes(), pdf["band"].to_numpy().tobytes(), b"".join(pdf["v"]), sizes.tobytes(), np.concatenate(pdf["ids"].to_list()).astype("i8").tobytes(), np.concatenate(pdf["scores"].to_list()).astype("f4").tobytes(), bytes(int(sizes.sum())))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *row, 1)], columns=["bucket", "node", "band", "v", "sizes", "ids", "scores", "seen", "open"])

    def ask(batches):
        for batch in batches:
            for bucket, v, sizes, ids, scores, seen in zip(*(batch.column(c).to_pylist() for c in ("bucket", "v", "sizes", "ids", "scores", "seen"))):
                v, sizes, ids, scores = np.frombuffer(v, "f4").reshape(-1, width), np.frombuffer(sizes, "i4"), np.frombuffer(ids, "i8"), np.frombuffer(scores, "f4")
                query = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.cumsum(sizes)
                floors = np.where(sizes >= beam, scores[np.minimum(ends - sizes + beam, len(scores)) - 1], -np.inf).astype("f4")
                new = np.flatnonzero(~np.frombuffer(seen, bool))
                new = new[places(query[new]) < expand]
                to = ids[new] % buckets
                order = np.argsort(to, kind="stable")
                out = []
                for rows in np.split(new[order], np.flatnonzero(np.diff(to[order])) + 1) if len(new) else ():
                    own, at = np.unique(query[rows], return_inverse=True)
                    out.append((int(ids[rows[0]] % buckets), bucket, own.astype("i4").tobytes(), v[own].tobytes(), floors[own].tobytes(), at.astype("i4").tobytes(), ids[rows].tobytes()))
                if out:
                    yield batch_of(dict(zip(("to", "source", "query", "v", "floor", "at", "node"), map(list, zip(*out)))))

    def score(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame(columns=["to", "source", "query", "ids", "scores"])
        centers, count, members, _, ids, x = around(known, width)
        ends = np.cumsum(count)
        query, v, floor = joined(asked["query"], "i4"), joined(asked["v"], "f4").reshape(-1, width), joined(asked["floor"], "f4")
        offset = np.cumsum([0, *(len(q) // 4 for q in asked["query"])])
        at = np.concatenate([np.frombuffer(a, "i4") + o for a, o in zip(asked["at"], offset)])
        node = joined(asked["node"], "i8")
        row = np.minimum(np.searchsorted(centers, node), len(centers) - 1)
        order = np.flatnonzero(centers[row] == node)  # all but a node without any neighbour
        order = order[np.argsort(row[order], kind="stable")]
        pairs, pair_count = at[order], count[row[order]]
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row[order])) + 1, [len(order)]])  # runs of one node
        begins = np.concatenate([[0], np.cumsum(pair_count)])
        a = 0
        while a < len(cuts) - 1 and len(order):
            b = max(a + 1, int(np.searchsorted(begins[cuts], begins[cuts[a]] + PAIRS, "right")) - 1)  # nodes a to b give some PAIRS scores
            scores, at_member = np.empty(begins[cuts[b]] - begins[cuts[a]], np.float32), []
            for p, q in zip(cuts[a:b].tolist(), cuts[a + 1 : b + 1].tolist()):
                r = row[order[p]]
                own = members[ends[r] - count[r] : ends[r]]
                np.matmul(v[pairs[p:q]], x[own].T, out=scores[begins[p] - begins[cuts[a]] : begins[q] - begins[cuts[a]]].reshape(q - p, -1))
                at_member.extend([own] * (q - p))
            pair = np.repeat(np.arange(cuts[a], cuts[b]), pair_count[cuts[a] : cuts[b]])
            good = np.flatnonzero(~(scores < floor[pairs][pair]))  # an overflow is no reason to drop a node
            found.append((pairs[pair[good]], np.concatenate(at_member)[good], scores[good]))
            a = b
        at, member, scores = (np.concatenate(f) for f in zip(*found))
        _, once = np.unique(at * len(ids) + member, return_index=True)  # in the order of queries
        at, member, scores = at[once], member[once], scores[once]
        cuts = np.searchsorted(at, offset)
        out = [(source, asked["to"].iloc[0], query[at[a:b]].tobytes(), ids[member[a:b]].tobytes(), scores[a:b].tobytes()) for source, a, b in zip(asked["source"], cuts, cuts[1:]) if b > a]
        return pd.DataFrame(out, columns=["to", "source", "query", "ids", "scores"])

    def merge(old: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not old["open"].iloc[0]:
            return old
        sizes, ids, scores, seen = (joined(old[c], kind) for c, kind in (("sizes", "i4"), ("ids", "i8"), ("scores", "f4"), ("seen", bool)))
        query, more, more_scores = joined(found["query"], "i4"), joined(found["ids"], "i8"), joined(found["scores"], "f4")
        order = np.argsort(query.astype("u2") if len(sizes) < 1 << 16 else query, kind="stable")
        more, more_scores = more[order], more_scores[order]
        cuts, ends = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(sizes)))]), np.cumsum(sizes)
        out: tuple[list, list, list] = [], [], []
        for q, (a, b) in enumerate(zip(ends - sizes, ends)):
            own, own_scores, own_seen = ids[a:b], scores[a:b], seen[a:b]
            if not own_seen.all():
                own_seen = own_seen.copy()
                own_seen[np.flatnonzero(~own_seen)[:expand]] = True
                all_ids, all_scores = np.concatenate([own, more[cuts[q] : cuts[q + 1]]]), np.concatenate([own_scores, more_scores[cuts[q] : cuts[q + 1]]])
                order = np.argsort(all_ids)
                first = np.minimum.reduceat(order, np.concatenate([[0], np.flatnonzero(np.diff(all_ids[order])) + 1]))  # what the list has comes first
                if len(first) > beam:
                    first = first[all_scores[first] >= np.partition(all_scores[first], -beam)[-beam]]
                best = first[np.argsort(-all_scores[first], kind="stable")[:beam]]
                own, own_scores = all_ids[best], all_scores[best]
                own_seen = np.concatenate([own_seen, np.zeros(len(all_ids) - (b - a), bool)])[best]
            for column, value in zip(out, (own, own_scores, own_seen)):
                column.append(value)
        seen = np.concatenate(out[2])
        return old.assign(sizes=[np.array([len(o) for o in out[0]], "i4").tobytes()], ids=[np.concatenate(out[0]).tobytes()], scores=[np.concatenate(out[1]).tobytes()], seen=[seen.tobytes()], open=np.int32(not seen.all()))

    def unpack(batches):
        for batch in batches:
            for node, band, sizes, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("node", "band", "sizes", "ids", "scores"))):
                sizes, ids, scores = np.frombuffer(sizes, "i4"), np.frombuffer(ids, "i8"), np.frombuffer(scores, "f4")
                first = np.flatnonzero(places(np.repeat(np.arange(len(sizes)), sizes)) < kept)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(sizes, kept))]).astype("i4"))
                both = [pa.ListArray.from_arrays(offsets, pa.array(c[first])) for c in (ids, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(node, "i8")), pa.array(np.frombuffer(band, "i8")), *both], ["node", "band", "ids", "scores"])

    parts = max(1, -(-queries * beam // ENTRIES_HELD), min(BUCKETS, queries // 32))
    state = begun.withColumn("bucket", F.pmod(F.xxhash64("node", "band"), F.lit(parts)))
    state = stored(state.select("bucket", "node", "band", "v", "ids", "scores").groupBy("bucket").applyInPandas(pack, SEARCH), "search")
    while not state.where("open = 1").isEmpty():  # a node is looked at once, so a search ends
        asked = state.where("open = 1").mapInArrow(ask, ASKED)
        found = asked.groupBy("to").cogroup(links.groupBy("to")).applyInPandas(score, FOUND)
        before, state = state, stored(state.groupBy("bucket").cogroup(found.groupBy("to")).applyInPandas(merge, SEARCH), "search")
        forget(before)
    return state.mapInArrow(unpack, "node long, band long, ids array<long>, scores array<float>")


def measured(rows: DataFrame) -> DataFrame:
    """rows with the length n and the norm of x, which no square overflows."""
    rows = rows.withColumn("_m", F.array_max(F.transform("x", F.abs)))
    norm = F.col("_m") * F.sqrt(F.expr("aggregate(x, 0D, (a, v) -> a + (v / _m) * (v / _m))"))
    return rows.select("vec_id", "x", F.size("x").alias("n"), norm.alias("norm"))


def nearest_of_all(firsts: DataFrame, queries: list, count: int) -> dict[int, set[int]]:
    """The `count` nodes of largest product with each of a few queries (node, x), themselves left out: one scan, in which a task keeps the best of what it reads."""
    if not queries:
        return {}
    names, q = [r.node for r in queries], np.array([r.x for r in queries], float)
    sent = firsts.sparkSession.sparkContext.broadcast((np.array(names, np.int64), q / np.abs(q).max(axis=1, keepdims=True)))

    def best(batches):
        names, q = sent.value
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(names)
        for batch in slices(batches, 4096):
            ids, s = batch.column("node").to_numpy(), floats(batch.column("x"), q.shape[1]) @ q.T
            for i, name in enumerate(names.tolist()):
                other = ids != name
                held[i] = best_of(np.concatenate([held[i][0], ids[other]]), np.concatenate([held[i][1], s[other, i]]), count)
        rows = [(name, n, v) for name, (ids, scores) in zip(names.tolist(), held) for n, v in zip(ids.tolist(), scores.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["query", "node", "score"])

    found = firsts.select("node", "x").mapInArrow(best, "query long, node long, score double")
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("_n") <= count)
    out: dict[int, set[int]] = {}
    for r in ranked.collect():
        out.setdefault(r.query, set()).add(r.node)
    return out


def share_found(found: DataFrame, truth: dict[int, set[int]], kept: int) -> float:
    """The share of the nearest in truth that the first `kept` found of a search hold."""
    lists: dict[int, set[int]] = {}
    for r in found.where(F.col("node").isin(list(truth))).select("node", F.slice("ids", 1, kept + 1).alias("ids")).collect() if truth else []:
        lists.setdefault(r.node, set()).update(r.ids)
    wanted = sum(map(len, truth.values()))
    return sum(len(t & lists.get(q, set())) for q, t in truth.items()) / wanted if wanted else 1.0


def nearest(
    vectors: DataFrame, is_query, count: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, reverse: int = REVERSE, changed: float = CHANGED,
    trees: int = TREES, group: int = GROUP, sample_rows: int = SAMPLE_ROWS, beam: int = BEAM, width: int = WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id and score: the `count` rows found nearest to each row whose vec_id meets is_query, a function of a column."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = measured(usable(vectors, vec_id, embedding))
    lengths = rows.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.max("norm").alias("most")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    dims, most = lengths["n"], lengths["most"]
    rows = rows.where(F.col("n") == dims)
    name = F.xxhash64("x").alias("node")
    band = F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(most) / F.col("norm")))).cast("long")
    firsts = stored(rows.groupBy("x").agg(F.min("norm").alias("norm")).select("x", name, band.alias("band")), "distinct-vectors")
    # The first copies of each vector are all that a query can be given; the partial window drops the rest before the shuffle.
    of_vector = Window.partitionBy("node").orderBy("vec_id")
    members = rows.select("vec_id", name).withColumn("_copy", F.row_number().over(of_vector)).where(F.col("_copy") <= count + 1)
    members = stored(members.select("node", "vec_id"), "members")
    asked = stored(rows.where(is_query(F.col("vec_id"))).select("vec_id", name, F.monotonically_increasing_id().alias("_query_row")), "queries")

    def vectors_of(batches):
        for batch in slices(batches, 4096):
            x = floats(batch.column("x"), dims)
            largest = np.abs(x).max(axis=1, keepdims=True)
            norm = largest * np.sqrt(((x / largest) ** 2).sum(axis=1, keepdims=True))
            share = np.exp2(np.log2(norm) - np.log2(most) + batch.column("band").to_numpy()[:, None])  # of the band's largest norm
            scaled = x / norm * share
            rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
            rest[rest < 1e-4] = 0.0
            long = np.column_stack([scaled, rest])
            query = np.column_stack([x / norm, np.zeros(len(x))])
            columns = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (long.astype("f2"), query.astype("f4"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("band"), *columns], ["node", "band", "v", "as_query"])

    nodes = stored(firsts.mapInArrow(vectors_of, "node long, band long, v binary, as_query binary"), "nodes")
    totals = {r["band"]: r["count"] for r in nodes.groupBy("band").count().collect()}  # as many rows as powers of two between norms
    total, wide = sum(totals.values()), dims + 1
    buckets = max(1, -(-total // BUCKET), min(BUCKETS, total // SMALL))
    better = stored(first_neighbours(nodes, totals, wide, k, trees, group, sample_rows, buckets), "better")
    graph = stored(merged(packed(nodes, k, buckets), better, k), "graph")
    forget(better)
    for draw in itertools.count() if total > 1 else ():
        before, graph = graph, stored(descend(graph, wide, k, reverse, buckets, draw), "graph")
        forget(before)
        if share_changed(graph) <= changed:
            break
    links = bucketed(gathered(graph, k, max(reverse, FOLLOWED), buckets).select("to", "source", "center", "index", "fresh", "ids", "v"), "to", buckets, "links")
    starts = stored(asked.select("node").distinct().join(nodes.select("node", "band", F.col("as_query").alias("v")), "node"), "starts")
    queries = starts.count()
    begun = starts.select("node", "band", "v", F.array("node").alias("ids"), F.array(F.lit(1.0).cast("float")).alias("scores"))
    if len(totals) > 1:
        # Products with the query's direction: those of a band are at most its largest norm.
        entry = [r for b, n in totals.items() for r in nodes.where((F.col("band") == b) & drawn("node", ENTRIES / n, 11)).select("node", "band", "v").collect()]  # about ENTRIES of each band
        entries = {b: ([r.node for r in entry if r.band == b], b"".join(bytes(r.v) for r in entry if r.band == b)) for b in totals}
        sent = spark.sparkContext.broadcast(entries)

    def searched(beam: int, width: int) -> DataFrame:
        """node and ids, the best found in each band."""
        found = search(begun, queries, links, buckets, wide, beam, width, 3 * count + 1)
        if len(totals) == 1:
            return found.select("node", "ids")

        def others(batches):
            points = {b: (np.array(i, np.int64), np.frombuffer(v, "f2").reshape(-1, wide).astype(np.float32)) for b, (i, v) in sent.value.items()}
            for batch in slices(batches):
                out: tuple[list, ...] = [], [], [], [], []
                for node, own, kth, v in zip(*(batch.column(c).to_pylist() for c in ("node", "band", "kth", "v"))):
                    for b, (ids, x) in points.items():
                        if b != own and len(ids) and 2.0**-b > kth * 2.0**-own - 0.01 * 2.0 ** -min(own, b):
                            for column, value in zip(out, (node, b, v, *best_of(ids, x @ np.frombuffer(v, "f4"), beam))):
                                column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], ["node", "band", "v", "ids", "scores"])

        kth = found.select("node", F.coalesce(F.try_element_at("scores", F.lit(count + 1)), F.lit(float("-inf"))).alias("kth"))
        rest = starts.join(kth, "node").mapInArrow(others, "node long, band long, v binary, ids array<long>, scores array<float>")
        found = found.union(search(rest, queries * (len(totals) - 1), links, buckets, wide, beam, width, 3 * count + 1))
        return found.select("node", "ids")

    checked = stored(asked.select("node").distinct().where(drawn("node", CHECKED / max(1, queries), 17)).join(firsts.select("node", "x"), "node"), "checked")
    truth = nearest_of_all(firsts, checked.select("node", "x").collect(), count)
    while True:
        found = searched(beam, width)
        recall = share_found(found, truth, 3 * count)
        log.info("a beam of %d finds %.3f of the nearest of %d queries", beam, recall, len(truth))
        if recall >= TARGET or beam >= total:
            break
        beam, width = beam * WIDER, width * WIDER
    forget(links)

    # Exact scores of the best nodes, and of the query's own, for its copies.
    tops = found.select(F.col("node").alias("query"), F.explode(F.concat(F.array("node"), F.slice("ids", 1, 3 * count))).alias("node")).distinct()
    both = tops.join(firsts.select("node", F.col("x").alias("y")), "node").join(firsts.select(F.col("node").alias("query"), "x"), "query")

    def exact(batches):
        for batch in slices(batches, 4096):
            x, y = (floats(batch.column(c), dims) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array((x * y).sum(axis=1))], ["query", "node", "score"])

    scored = both.select("query", "node", "x", "y").mapInArrow(exact, "query long, node long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = stored(scored.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= 3 * count).drop("_n"), "scored")
    final = Window.partitionBy("_query_row").orderBy(F.desc("score"), "vec_id")
    # _query_row tells queries with the same vec_id apart.
    expanded = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), "_query_row").join(scored, "query").join(members, "node")
    ranked = expanded.where("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= count)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark, sf_dir):
    from .shared import table

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
