"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key, ranked within their source and ordered by rank / source size,
so that any run of consecutive rows holds the sources in the proportions of the whole; the order
is then cut into shards whose counts differ by one at most (law `rows`).

Ranks come from counts: rows fall into buckets by a prefix of the sort key, running totals of the
bucket counts give each bucket's first rank, and only the rows of one bucket are sorted together.
No source, however large, is sorted in one task.

The key is a hash of doc_id and of the text's checksum, for rows without a doc_id also of their place in the input, so that
even a third of all rows without one are spread over all buckets.

Nulls: a null source is a source of its own, a null text has no bytes, a null doc_id sorts first.
Repeated rows each take a slot. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored, utf8_bytes

SHARDS = 24
SEED = 20_240_611
BUCKET_ROWS = 512
#: Buckets whose counts one task adds up.
SPAN = 4096


def first_ranks(counts: DataFrame, group: list[str], bucket: str, n: str) -> DataFrame:
    """Adds `before`, the sum of n over smaller buckets of the group, in two levels of running sums."""
    at = counts.withColumn("_span", F.floor(F.col(bucket) / SPAN))
    low = Window.partitionBy(*group, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    spans = at.groupBy(*group, "_span").agg(F.sum(n).alias("_n"))
    high = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*group, "_span", F.coalesce(F.sum("_n").over(high), F.lit(0)).alias("_spans_before"))
    return (
        at.withColumn("_in_span", F.coalesce(F.sum(n).over(low), F.lit(0)))
        .join(spans, [*group, "_span"])
        .withColumn("before", F.col("_in_span") + F.col("_spans_before"))
        .drop("_span", "_in_span", "_spans_before")
    )


def ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], out: str) -> DataFrame:
    """Adds the rank from 1 within the group, for an order that never goes down from bucket to bucket."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = first_ranks(counts, group, bucket, "_n").select(*group, bucket, "before")
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    return (
        rows.withColumn("_within", F.row_number().over(within))
        .join(starts, [*group, bucket])
        .withColumn(out, F.col("before") + F.col("_within"))
        .drop("before", "_within")
    )


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of docs."""
    rows = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"),
            (utf8_bytes("text") + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("string")).cast("binary")).alias("_key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    ties = ["_key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets))
    rows = ranked(rows, ["_source"], "_bucket", ties, "_rank")
    sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of"))
    # Each source begins at a place of its own, or sources of one size would come in lumps.
    phase = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_source").cast("binary")), 1, 5), 16, 10).cast("double") + 0.5) / float(1 << 20)
    rows = rows.join(sizes, "_source").withColumn("_fraction", (F.col("_rank") - phase) / F.col("_of"))
    rows = rows.withColumn("_part", F.floor(F.col("_fraction") * buckets))
    rows = ranked(rows, [], "_part", ["_fraction", "_source", *ties], "_at")
    shard = F.expr(f"((_at - 1) * {shards}) div {max(1, total)}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        F.when(F.col("_source") != "", F.substring("_source", 2, 2**31 - 1)).alias("source"),
        "size",
        "text_crc32",
        "shard",
        F.expr(f"_at - 1 - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
    )


def op7_sharding(spark, sf_dir):
    from .shared import table

    out = interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: crc32 over the bytes of a text, which the other engine has no function for: the remainder of each byte, then a fold over the bytes.
OP7_SQL = f"""
WITH bits AS (
  SELECT list(list_reduce(range(0, 8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b) ORDER BY b) AS remainders
  FROM (SELECT unnest(range(0, 256)) AS b)
), raw AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS s FROM documents
), hashed AS (
  SELECT doc_id, s, octet_length(encode(t)) + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM raw, bits
), keyed AS (
  SELECT *, md5('{SEED}:' || doc_id || ':' || text_crc32) AS k, (('0x' || substr(md5('{SEED}:' || s), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576 AS phase FROM hashed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) AS r, count(*) OVER (PARTITION BY s) AS of_source FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - phase) / of_source, s, k, doc_id) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // n)::INT AS shard, place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard,
  CASE WHEN s <> '' THEN substr(s, 2) END AS source
FROM placed
"""
