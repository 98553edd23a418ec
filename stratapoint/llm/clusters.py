"""Centroid clustering in whole numbers by partial-distance search.

Vectors become whole numbers once, stored with each row. A round is one pass: a task takes rows in blocks, holds each vector's
best distance so far, and adds a further centroid's squared differences a few dimensions at a time, those of highest variance
first; a vector leaves that centroid as soon as its sum is strictly above its best. Whoever stays to the last dimension has an exact
distance. Each task sends only counts and component sums of its clusters, exact at any size, which Spark adds up; the next centroids are floors of means.
Centroids, the only thing the driver holds, are as many as asked for and do not grow with the table.

Only vectors of exactly `dimensions` components, none null or non-finite, take part. A null id hashes to nothing: its vector is clustered but is never a first
centroid, unless fewer than `clusters` have an id; ties of the hash go to the smaller vector. With fewer vectors than clusters there are as many centroids as
vectors. Vectors whose components pass 2^27 are reckoned in Python's unbounded integers; a distance or inertia beyond a long is null.
Repeated rows are clustered each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import slices, stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Dimensions whose differences are added before vectors are let go.
STEP = 8
#: Components up to here keep sums of squared differences of a vector within 64 bits, for up to 128 dimensions.
SAFE = 1 << 27
LONG = (1 << 63) - 1

Centroids = list[list[int]]


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, the components as whole numbers in `whole` where they are small, else as decimal text in `large`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("whole", pa.list_(pa.int64())), ("large", pa.list_(pa.string()))])
        for batch in slices(batches, 4096):
            rows = batch.column("x").combine_chunks() if isinstance(batch.column("x"), pa.ChunkedArray) else batch.column("x")
            x = np.asarray(rows.flatten(), float).reshape(-1, dimensions)
            small = (np.abs(x) < SAFE // scale).all(axis=1)
            whole = np.floor(np.where(small[:, None], x, 0.0) * scale).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(small, dimensions, 0)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole[small].reshape(-1)), mask=pa.array(~small))
            large = [None if s else [str(math.floor(scale * int(v)) if v == int(v) else math.floor(scale * v)) for v in row.tolist()] for s, row in zip(small.tolist(), x)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), listed, pa.array(large, pa.list_(pa.string()))], schema=schema)

    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & finite)
    return rows.mapInArrow(run, "vec_id long, whole array<long>, large array<string>")


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> Centroids:
    """The vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(hashed.alias("_hash"), "whole", "large").orderBy(F.asc_nulls_last("_hash"), F.asc_nulls_last("whole"), "large").limit(clusters).collect()
    return [[int(v) for v in (r.large if r.whole is None else r.whole)] for r in rows]


def by_variance(kept: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions, those of highest variance first."""
    spread = kept.agg(*(F.var_pop(F.col("whole")[i].cast("double")) for i in range(dimensions))).first()
    return np.argsort([-(v or 0.0) for v in spread], kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row; dimensions stand in the order in which they are added."""
    best, found = ((x - centroids[0]) ** 2).sum(axis=1), np.zeros(len(x), np.int32)
    for number in range(1, len(centroids)):
        rows, total = np.arange(len(x)), np.zeros(len(x), x.dtype)
        for at in range(0, x.shape[1], step):
            total = total + ((x[rows, at : at + step] - centroids[number, at : at + step]) ** 2).sum(axis=1)
            stays = total <= best[rows]
            rows, total = rows[stays], total[stays]
            if not len(rows):
                break
        closer = total < best[rows]  # a tie stays with the smaller number
        best[rows[closer]], found[rows[closer]] = total[closer], number
    return found, best


def blocks(batch: pa.RecordBatch, order: np.ndarray, centroids: Centroids) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, whole vectors and centroids in the order of the dimensions, first of the small vectors, then of the large ones."""
    whole, c = batch.column("whole"), np.array(centroids, object)[:, order]
    is_small = np.asarray(whole.is_valid())
    small, large = np.flatnonzero(is_small), np.flatnonzero(~is_small)
    if len(small):
        x = np.asarray(whole.drop_null().flatten(), np.int64).reshape(len(small), -1)[:, order]
        if max(map(abs, c.ravel())) < SAFE:
            yield small, x, c.astype(np.int64)
        else:
            yield small, x.astype(object), c
    if len(large):
        yield large, np.array([[int(v) for v in r] for r in batch.column("large").drop_null().to_pylist()], object)[:, order], c


def sums(kept: DataFrame, centroids: Centroids, order: np.ndarray) -> DataFrame:
    """cluster, dimension, sum of its components and number of its vectors, added up in each task first."""
    k, d = len(centroids), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [[0] * d for _ in range(k)], [0] * k
        for batch in slices(batches, 8192):
            for _, x, c in blocks(batch, order, centroids):
                found, _ = nearest(x, c)
                for j in np.unique(found).tolist():
                    own = x[found == j]
                    n[j] += len(own)
                    total[j] = [a + int(b) for a, b in zip(total[j], own.sum(axis=0))]
        rows = [(j, int(order[i]), str(total[j][i]), n[j]) for j in range(k) if n[j] for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["cluster", "dimension", "part", "rows"])

    return kept.select("whole", "large").mapInArrow(run, "cluster int, dimension int, part string, rows long")


def moved(kept: DataFrame, centroids: Centroids, order: np.ndarray) -> Centroids:
    """The centroids after one round: floors of means where there are vectors."""
    parts = sums(kept, centroids, order)
    within = F.length("part") <= 18
    # Parts of 18 digits are added as Decimal; larger ones, which only huge components make, come one by one, at most one a task.
    added = parts.groupBy("cluster", "dimension").agg(
        F.sum(F.when(within, F.col("part").cast("decimal(18,0)"))).alias("sum"), F.collect_list(F.when(~within, F.col("part"))).alias("beyond"), F.sum("rows").alias("rows")
    )
    out = [list(c) for c in centroids]
    for r in added.collect():
        out[r.cluster][r.dimension] = (int(r["sum"] or Decimal(0)) + sum(map(int, r.beyond))) // r.rows
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    kept = stored(kept_vectors(vectors, dimensions, scale), "whole-vectors")
    centroids, order = first_centroids(kept, clusters, seed), by_variance(kept, dimensions)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(kept, centroids, order)
        if before == centroids:
            break  # further rounds would change nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for rows, x, c in blocks(batch, order, centroids):
                found, best = nearest(x, c)
                cluster[rows] = found
                for row, value in zip(rows.tolist(), best.tolist()):
                    distance[row] = str(value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.string())], ["vec_id", "cluster", "_distance"])

    if not centroids:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    found = stored(kept.mapInArrow(run, "vec_id long, cluster int, _distance string"), "clustered")
    exact = F.when(F.length("_distance") <= 37, F.col("_distance").cast("decimal(38,0)"))
    totals = found.groupBy("cluster").agg(F.when(F.count(exact) == F.count(F.lit(1)), F.sum(exact)).alias("_sum")).collect()
    own = {r.cluster: None if r["_sum"] is None else int(r["_sum"]) for r in totals}
    whole = None if None in own.values() else sum(own.values())
    named = [(j, _long(own.get(j)), _long(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = kept.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.withColumn("distance", F.expr("try_cast(_distance AS long)"))
    return out.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int | None) -> int | None:
    return value if value is not None and value <= LONG else None


def op12_clusters(spark, sf_dir):
    from .shared import table

    return clustered(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """One round of the SQL: assignment to c{i}, and the centroids c{i+1} that it leads to."""
    return f"""
a{i} AS MATERIALIZED (SELECT row_id, c, d FROM (
  SELECT row_id, c, list_sum([(x[j] - m[j]) * (x[j] - m[j]) for j in range(1, {DIMENSIONS + 1})])::BIGINT AS d FROM kept, c{i})
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1),
p{i} AS (SELECT c, j, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(x) AS v, unnest(range(1, {DIMENSIONS + 1})) AS j FROM a{i} JOIN kept USING (row_id)) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM p{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, [floor({SCALE} * v::DOUBLE)::BIGINT for v in embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, x AS m FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS}),
{",".join(map(_round, range(ROUNDS)))},
last AS (SELECT row_id, c, d FROM (
  SELECT row_id, c, list_sum([(x[j] - m[j]) * (x[j] - m[j]) for j in range(1, {DIMENSIONS + 1})])::BIGINT AS d FROM kept, c{ROUNDS})
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN kept USING (row_id) JOIN c{ROUNDS} USING (c)
"""
