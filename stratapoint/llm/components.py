"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import forget, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each node's larger neighbours (or its smaller ones and itself) to the smallest node beside it.

    The smallest neighbour of each node is stored before it is joined, so that both sides of the join
    come straight from exchanges and Spark can split a node with many edges.
    """
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-minima")
    if larger:
        out = pairs.join(least, "u").where(F.col("v") > F.col("u"))
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    """Number, sum and parity of 64-bit hashes: two sets of edges agree in all by chance with odds of about 2^-128."""
    total = F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total, F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links: long columns u and v. Returns node and component, the smallest node reachable; nodes without links are not in it."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    sign = _sign(edges)
    for _ in range(rounds):
        larger = stored(_star(edges, True), "large-star")
        before, edges = edges, stored(_star(larger, False), "small-star")
        forget(before)
        forget(larger)
        if (now := _sign(edges)) == sign:
            break
        sign = now
    else:
        raise RuntimeError("the components did not settle")
    # Settled, every edge leads from a node to the root of its star.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
