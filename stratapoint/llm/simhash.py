"""SimHash near-dedup with vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints become one row. Two
fingerprints that differ in at most `radius` bits differ in at most radius // 2 of one of their two
32-bit halves, so each half has a vantage-point tree of its own, searched with that smaller radius:
the triangle bound then cuts off nearly all of a tree. The trees are grown on a bounded sample
(about `sample_rows`); their leaves are shards. A fingerprint belongs to the leaf on its side of every
vantage point's ball, and also visits each leaf that the triangle bound cannot rule out, so any two
fingerprints in reach of each other meet in a shard.

A shard that owns too many rows, because the corpus is large or because many fingerprints agree in a half, gets a tree of its own,
grown on a sample of its rows, and so on until none is too large; where a half cannot be split any more the other one is, with
the whole radius. Visitors of a shard are compared in portions. A comparison looks at all bits of the shard's own rows and of a portion
and returns a spanning forest of the links found, never the pairs; components over these
forests are the groups.

Nulls: a null text has no words and gets fingerprint zero, which links like any other. A null doc_id
joins its group but never names it; a group of null doc_ids alone has a null name. Repeated rows are listed each. Empty tables give empty results.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import forget, slices, stored

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints that the trees are grown on, about, and those that a shard should own; one of TOO_MANY times as many is split.
SAMPLE_ROWS = 65_536
SHARD_ROWS = 2_048
TOO_MANY = 4
#: Fingerprints that the tree of one shard is grown on, about, and visitors of a portion.
OWN_SAMPLE, PORTION = 4_096, 32_768
HALVES = (0, 32)
LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if over half of the shingles' XXH64 values have it; as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    counts, n = np.zeros(64, np.int64), len(stops)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 65_536):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + 65_536], stops[a : a + 65_536])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, ball radius, inner, outer); a leaf is (0, -1, its number, 0)."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def add(own: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((0, -1, 0, 0))
        if len(own) > leaf:
            best = None
            for v in rng.choice(own, 4):
                d = np.bitwise_count(own ^ v)
                mu = int(np.median(d))
                for m in (mu - 1, mu):
                    if 0 < (inside := int((d <= m).sum())) < len(own):
                        # the even split with the fewest points within reach of the boundary
                        near = int((np.abs(d.astype(int) - m) <= 1).sum())
                        cost = near + abs(2 * inside - len(own)) / 2
                        if best is None or cost < best[0]:
                            best = cost, int(v), m, d <= m
            if best is not None:
                _, v, m, mask = best
                nodes[at] = (v, m, add(own[mask]), add(own[~mask]))
                return at
        nodes[at] = (0, -1, leaves, 0)
        leaves += 1
        return at

    add(points)
    return nodes


def visits(nodes: list[tuple[int, int, int, int]], points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a point, a leaf that it visits, and whether it belongs there."""
    out = []
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, own, home = stack.pop()
        if not len(own):
            continue
        v, m, inner, outer = nodes[at]
        if m < 0:
            out.append((own, np.full(len(own), inner), home))
            continue
        d = np.bitwise_count(points[own] ^ np.uint64(v)).astype(int)
        go = d - reach <= m
        stack.append((inner, own[go], (home & (d <= m))[go]))
        go = d + reach > m
        stack.append((outer, own[go], (home & (d > m))[go]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def forest(fp: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (row, row) that connect all rows that any link to an own row connects."""
    root = np.arange(len(fp))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    own = np.flatnonzero(home)
    step = max(1, 4_000_000 // max(1, len(fp)))
    for a in range(0, len(own), step):
        rows = own[a : a + step]
        i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius)
        i = rows[i]
        for x, y in zip(i[i != j].tolist(), j[i != j].tolist()):
            if (x := find(x)) != (y := find(y)):
                root[max(x, y)] = min(x, y)
                links.append((x, y))
    return links


ROUTED = "shard string, half int, reach int, fp long, home boolean"


def part_of(fp: np.ndarray, half: int) -> np.ndarray:
    return (fp >> np.uint64(HALVES[half])) & LOW


def near_links(distinct: DataFrame, radius: int = RADIUS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, own_sample: int = OWN_SAMPLE, portion: int = PORTION) -> DataFrame:
    """distinct: fp, each once. Returns links u, v between fingerprints."""
    spark = distinct.sparkSession
    total = distinct.count()
    drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(sample_rows / max(1, total) * (1 << 40))
    sample = distinct.where(drawn).select("fp").collect()  # about sample_rows rows, whatever the total
    points = np.sort(np.array([r.fp for r in sample], np.int64)).view(np.uint64)
    leaf = max(2, int(len(points) * shard_rows / max(1, total)))
    rng = np.random.default_rng(SEED)
    sent = spark.sparkContext.broadcast([grow(part_of(points, half), leaf, rng) for half in range(len(HALVES))])  # no larger than the sample

    def route(batches):
        for batch in slices(batches, 65_536):
            fp = batch.column(0).to_numpy().view(np.uint64)
            for half, nodes in enumerate(sent.value):
                at, leaves, home = visits(nodes, part_of(fp, half), radius // len(HALVES))
                names = [f"{half}.{x}" for x in leaves.tolist()]
                same = [np.full(len(at), x, np.int32) for x in (half, radius // len(HALVES))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, same), batch.column(0).take(pa.array(at)), pa.array(home)], ["shard", "half", "reach", "fp", "home"])

    routed = stored(distinct.select("fp").mapInArrow(route, ROUTED), "routed-fingerprints")
    while True:
        sizes = routed.groupBy("shard").agg(F.sum(F.col("home").cast("long")).alias("n_home"), F.count(F.lit(1)).alias("n"))
        sizes = stored(sizes, "shard-sizes")
        large = sizes.where((F.col("n_home") > TOO_MANY * shard_rows) & ~F.col("shard").endswith("!"))
        if large.isEmpty():
            break
        before, routed = routed, stored(split(routed, large, radius, shard_rows, own_sample, portion), "routed-fingerprints")
        forget(before)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        fp = pdf["fp"].to_numpy()
        at = np.array(forest(fp.view(np.uint64), pdf["home"].to_numpy(), radius), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": fp[at[:, 0]], "v": fp[at[:, 1]]})

    # Every portion of a shard's visitors meets all of its own rows.
    salts = F.ceil(F.col("n") / portion).cast("int")
    salted = routed.join(sizes.where("n_home > 0").select("shard", salts.alias("salts")), "shard")
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    one = F.array(F.pmod(F.xxhash64("fp", F.lit(3)), F.col("salts")).cast("int"))
    salted = salted.select("shard", "fp", "home", F.explode(F.when(F.col("home"), every).otherwise(one)).alias("salt"))
    return salted.groupBy("shard", "salt").applyInPandas(link, "u long, v long").distinct()


def split(routed: DataFrame, large: DataFrame, radius: int, shard_rows: int, own_sample: int, portion: int) -> DataFrame:
    """routed with trees grown in the shards listed in large (shard, n_home, n). The name of a shard that cannot be split gets a ! at its end."""

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, first = pdf["fp"].to_numpy().view(np.uint64), pdf.iloc[0]
        leaf = max(2, int(len(fp) * shard_rows / first["n_home"]))
        for half, reach in ((int(first["half"]), int(first["reach"])), (1 - int(first["half"]), radius)):
            nodes = grow(part_of(np.sort(fp), half), leaf, np.random.default_rng(SEED))
            if len(nodes) > 1:
                break
        return pd.DataFrame({"shard": [first["shard"]], "half": [half], "reach": [reach], "nodes": [np.array(nodes, np.int64).tobytes()], "n": [first["n"]]})

    def route(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["shard", "half", "reach", "fp", "home"]]
        nodes = [tuple(n) for n in np.frombuffer(trees["nodes"].iloc[0], np.int64).reshape(-1, 4).tolist()] if len(trees) else []
        if len(nodes) < 2:
            return rows.assign(shard=rows["shard"] + "!")
        half, reach = int(trees["half"].iloc[0]), int(trees["reach"].iloc[0])
        at, leaves, home = visits(nodes, part_of(rows["fp"].to_numpy().view(np.uint64), half), reach)
        out = rows.iloc[at]
        home = home & out["home"].to_numpy()
        return out.assign(shard=out["shard"] + np.array([f".{x}" for x in leaves.tolist()], object), half=half, reach=reach, home=home)

    rows = routed.join(large, "shard")
    share = F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(1 << 40)) < own_sample / F.col("n_home") * float(1 << 40)
    trees = stored(rows.where(F.col("home") & share).groupBy("shard").applyInPandas(plant, "shard string, half int, reach int, nodes binary, n long"), "shard-trees")
    salts = F.ceil(F.col("n") / portion).cast("int")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(3)), salts).cast("int"))
    copies = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    done = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(route, ROUTED)
    return routed.join(large.select("shard"), "shard", "left_anti").select(*done.columns).union(done)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the group, for every row of docs."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(near_links(distinct.select("fp"), radius, sample_rows, shard_rows))
    of_fp = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_fp = stored(of_fp, "fingerprint-groups")
    named = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = stored(of_fp.join(named, "component").select("fp", "component_id"), "fingerprint-names")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir):
    from .shared import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
