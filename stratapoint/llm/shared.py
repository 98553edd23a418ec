"""What the operators of this subpackage share: shared storage and small column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a batch that a Python task turns into objects at once.
ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none is one set, below the warehouse, which they share as well."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, tag: str) -> DataFrame:
    """As `stored`, but in buckets by a column: what groups by it again and again needs no shuffle."""
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", shared_path(df.sparkSession, tag)).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # from the catalog; the files stay until they are forgotten
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(shared_dir(spark)):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until df has no such column, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def portions(batches: Iterator[pa.RecordBatch], text: str, rows: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows that end once their texts have so many bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths.tolist()):
            held += n
            if held >= size or i + 1 - start == rows:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
