"""A store of tiles in Parquet: snapshots of immutable writes, metadata apart from the points, points by file, kind and depth."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Writes of tile metadata that a reader merges at most; one more merges them into a single one.
COMPACT_AFTER = 10
#: Tiles of a list that is sent to all tasks, at most.
SENT_KEYS = 100_000


def latest(batches: DataFrame, key: str = "id", version: str = "batch") -> DataFrame:
    """The last row of each key over all batches; rows without a key are ignored."""
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    return batches.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def in_order(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("file_index", "depth", "id")


@dataclass(frozen=True)
class Write:
    """A folder of tiles, of points, or of both. Later writes of a snapshot replace tiles of the same id; batch is the caller's number for an upsert."""

    name: str
    tiles: bool
    points: bool
    batch: int


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class TileStore:
    """Tiles and their points below one path.

    Data are written first, into a folder of their own; then one small file, the manifest of the next version, names all folders of that snapshot. A writer that is
    lost before it leaves the former snapshot as it was, tiles and points alike; one that another has overtaken is refused. Old
    snapshots stay readable (`at`) until `vacuum`. `save` replaces everything, `add` puts files beside those there, `upsert` writes tile metadata of which the
    last version of an id counts, `grow` does so with points; metadata of COMPACT_AFTER writes are merged into one.

    Points lie in partitions by file, kind and depth, sorted by tile, so that a lookup reads few row groups. The sample of a tile is the one of the last write
    that has the tile's points of kind `sample` (its `sample_write`); full points of all writes count.

    A point of kind `nested` is there once, for its leaf, and stands for many rows: it is a full point of the leaf and in the samples of all tiles on the way to
    it from the depth `top` on. Readers see rows of the kinds `full` and `sample` only.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    # Snapshots

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of all manifests begun, the last one first."""
        fs, path = self._fs("manifests")
        if not fs.exists(path):
            return []
        return sorted((int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")), reverse=True)

    def _manifest(self, version: int) -> list[Write] | None:
        """None for a manifest that its writer did not end."""
        fs, path = self._fs(f"manifests/{version:010d}.json")
        stream = fs.open(path)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return [Write(**w) for w in json.loads(raw)["writes"]]
        except ValueError:
            return None

    def snapshot(self) -> tuple[int, list[Write]]:
        """The version in use and its writes; version 0 is the empty store."""
        if self.version is not None:
            return self.version, self._manifest(self.version) or []
        for version in self.versions():
            if (writes := self._manifest(version)) is not None:
                return version, writes
        return 0, []

    def at(self, version: int) -> TileStore:
        """The store as it was then, to be read."""
        return TileStore(self.spark, self.path, version)

    def _commit(self, base: int, writes: list[Write]) -> None:
        if self.version is not None:
            raise ValueError("an old snapshot is not written to")
        listed = self.versions()
        if next((v for v in listed if self._manifest(v) is not None), 0) != base:
            raise Conflict(f"{self.path} has changed since version {base}")
        fs, path = self._fs(f"manifests/{max(listed, default=0) + 1:010d}.json")
        try:
            stream = fs.create(path, False)  # fails where another writer was faster
        except Exception as error:
            if fs.exists(path):
                raise Conflict(f"{self.path} has changed since version {base}") from error
            raise
        try:
            stream.write(bytearray(json.dumps({"writes": [asdict(w) for w in writes]}).encode()))
        finally:
            stream.close()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last `keep` snapshots, and the data that only others name. No writer may be at work."""
        whole = [(v, w) for v in self.versions() if (w := self._manifest(v)) is not None]
        kept = {w.name for _, writes in whole[:keep] for w in writes}
        for version in self.versions():
            if version not in {v for v, _ in whole[:keep]}:
                fs, path = self._fs(f"manifests/{version:010d}.json")
                fs.delete(path, False)
        fs, path = self._fs("data")
        for f in fs.listStatus(path) if fs.exists(path) else []:
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)

    # Writing

    def _write(self, tiles: DataFrame | None, points: DataFrame | None, batch: int) -> Write:
        name = uuid.uuid4().hex
        if points is not None:
            part = F.pmod(F.xxhash64("tile_id"), F.lit(16)).cast("int")
            part = F.coalesce("part", part) if "part" in points.columns else part
            order = ["file_index", "kind", "depth", *(["top"] if "top" in points.columns else []), "tile_id", "point_index"]
            dealt = points.repartition("file_index", "kind", "depth", part).drop("part").sortWithinPartitions(*order)
            dealt.write.partitionBy("file_index", "kind", "depth").parquet(f"{self.path}/data/{name}/points")
        if tiles is not None:
            own = tiles.drop("sample_write").withColumn("sample_write", F.lit(name if points is not None else None).cast("string"))
            own.write.parquet(f"{self.path}/data/{name}/tiles")
        return Write(name, tiles is not None, points is not None, batch)

    def save(self, tiles: DataFrame, points: DataFrame) -> None:
        """points: file_index, kind (sample or full), depth, tile_id and the points' own columns."""
        base, _ = self.snapshot()
        self._commit(base, [self._write(tiles, points, 0)])

    def add(self, tiles: DataFrame, points: DataFrame) -> None:
        """Another file's tiles and points beside those that are there."""
        self.grow(tiles, points, 0)

    def grow(self, tiles: DataFrame, points: DataFrame, batch: int) -> None:
        """Tiles that replace those of their ids, with their new samples, and full points beside those there, in one commit."""
        base, writes = self.snapshot()
        self._commit(base, self._compacted([*writes, self._write(tiles, points, batch)]))

    def upsert(self, tiles: DataFrame, batch: int) -> None:
        """Tile metadata. A batch that is written again, as a stream does after a failure, replaces its first writing."""
        base, writes = self.snapshot()
        before = [w for w in writes if w.points or w.batch != batch or not w.tiles]
        self._commit(base, self._compacted([*before, self._write(tiles, None, batch)]))

    def _compacted(self, writes: list[Write]) -> list[Write]:
        return self._merged(writes) if sum(w.tiles for w in writes) >= COMPACT_AFTER else writes

    def _merged(self, writes: list[Write]) -> list[Write]:
        one = uuid.uuid4().hex
        self._tiles(writes).write.parquet(f"{self.path}/data/{one}/tiles")
        points = [Write(w.name, False, True, w.batch) for w in writes if w.points]
        return [*points, Write(one, True, False, max(w.batch for w in writes))]

    def compact(self) -> None:
        """Merges the metadata of all writes into one."""
        base, writes = self.snapshot()
        if sum(w.tiles for w in writes) > 1:
            self._commit(base, self._merged(writes))

    def clear(self) -> None:
        base, _ = self.snapshot()
        self._commit(base, [])

    # Reading

    def _tiles(self, writes: list[Write]) -> DataFrame:
        own = [w for w in writes if w.tiles]
        if not own:
            return self.spark.read.parquet(f"{self.path}/tiles")  # there is none: Spark's own error for a table that does not exist
        read = lambda w, i: self.spark.read.parquet(f"{self.path}/data/{w.name}/tiles").withColumn("_write", F.lit(i))
        if len(own) == 1:
            return self.spark.read.parquet(f"{self.path}/data/{own[0].name}/tiles")
        rows = read(own[0], 0)
        for i, w in enumerate(own[1:], 1):
            rows = rows.unionByName(read(w, i), allowMissingColumns=True)
        newest = Window.partitionBy("id").orderBy(F.desc("_write"))
        # Metadata that came without points leave a tile's sample as it was.
        sample = F.first("sample_write", True).over(newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.where(F.col("id").isNotNull()).withColumns({"_n": F.row_number().over(newest), "sample_write": sample})
        return rows.where("_n = 1").drop("_n", "_write")

    def all_tiles(self) -> DataFrame:
        return in_order(self._tiles(self.snapshot()[1]).drop("sample_write"))

    def tiles(self, depth: int | None = None) -> DataFrame:
        """The same in no order, of one depth if given."""
        rows = self._tiles(self.snapshot()[1]).drop("sample_write")
        return rows if depth is None else rows.where(F.col("depth") == depth)

    def points(self) -> DataFrame:
        return self._points(None)

    def _raw(self) -> DataFrame | None:
        """The rows of all writes, each with its write's name."""
        rows = None
        for w in self.snapshot()[1]:
            if w.points:
                one = self.spark.read.parquet(f"{self.path}/data/{w.name}/points").withColumn("_write", F.lit(w.name))
                rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return rows if rows is not None else self.spark.read.parquet(f"{self.path}/points")  # there is none: as for tiles

    def _last(self, rows: DataFrame) -> DataFrame:
        """Points that count: of samples those of the tile's last write with points."""
        writes = self.snapshot()[1]
        if sum(w.points for w in writes) == 1:
            return rows.drop("_write")
        own_sample = self._tiles(writes).select(F.col("id").alias("_id"), "sample_write")
        kept = rows.where("kind = 'sample'").join(own_sample, (F.col("tile_id") == F.col("_id")) & (F.col("_write") == F.col("sample_write")), "left_semi")
        return rows.where("kind <> 'sample'").unionByName(kept).drop("_write")

    def _points(self, chosen: Column | None) -> DataFrame:
        """Points that count, of the partitions and tiles that `chosen` leaves."""
        raw = self._raw()
        pick = lambda rows: rows if chosen is None else rows.where(chosen)
        if "top" not in raw.columns:
            return self._last(pick(raw))
        plain, nested = raw.where("kind <> 'nested'").drop("top"), raw.where("kind = 'nested'")
        full = nested.drop("top").withColumn("kind", F.lit("full"))
        sample = nested.where("top <= depth").withColumn("depth", F.explode(F.sequence("top", "depth"))).drop("top")
        sample = sample.withColumns({"kind": F.lit("sample"), "tile_id": F.expr("substring_index(tile_id, '.', depth + 1)")})
        return self._last(pick(plain).unionByName(pick(full)).unionByName(pick(sample)))

    def _of_level(self, nested: DataFrame, depth: int) -> DataFrame:
        """Nested points as rows of the samples of one depth."""
        rows = nested.where((F.col("top") <= depth) & (F.col("depth") >= depth)).drop("top")
        return rows.withColumns({"kind": F.lit("sample"), "tile_id": F.substring_index("tile_id", ".", depth + 1), "depth": F.lit(depth)})

    def get(self, tile_id: str, kind: str = "sample") -> DataFrame:
        """The points of one tile: file and depth follow from its id and prune the partitions."""
        raw, file, depth = self._raw(), F.col("file_index") == int(tile_id.split(":")[0]), tile_id.count(".")
        rows = raw.where(file & (F.col("kind") == kind) & (F.col("depth") == depth) & (F.col("tile_id") == tile_id))
        if "top" in raw.columns:
            own = raw.where(file & (F.col("kind") == "nested"))
            below = F.col("tile_id") == tile_id
            if kind == "full":
                own = own.where(below & (F.col("depth") == depth)).drop("top").withColumn("kind", F.lit("full"))
            else:
                own = self._of_level(own.where(below | F.col("tile_id").startswith(f"{tile_id}.")), depth)
            rows = rows.drop("top").unionByName(own)
        return self._last(rows)

    def get_many(self, wanted: DataFrame) -> DataFrame:
        """The points of the tiles in wanted (id, source), which is read more than once; ids unknown give none. A list of SENT_KEYS tiles at most is sent to every task."""
        keys = wanted.select(F.col("id").alias("tile_id"), F.col("source").alias("kind"), F.substring_index("id", ":", 1).cast("int").alias("file_index"), (F.size(F.split("id", r"\.")) - 1).alias("depth"))
        raw, by = self._raw(), ["file_index", "kind", "depth", "tile_id"]
        sizes = {(r["kind"], r["depth"]): r["n"] for r in keys.groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each kind and depth
        few = sum(sizes.values()) <= SENT_KEYS
        asked = lambda rows, keys: rows.join(F.broadcast(keys) if few else keys, by, "left_semi")
        if "top" not in raw.columns:
            return self._last(asked(raw, keys))
        nested, rows = raw.where("kind = 'nested'"), asked(raw.where("kind <> 'nested'").drop("top"), keys)
        if any(kind == "full" for kind, _ in sizes):
            rows = rows.unionByName(asked(nested.drop("top").withColumn("kind", F.lit("full")), keys.where("kind = 'full'")))
        for kind, depth in sizes:
            if kind == "sample":
                rows = rows.unionByName(asked(self._of_level(nested, depth), keys.where((F.col("kind") == "sample") & (F.col("depth") == depth))))
        return self._last(rows)

    def where(self, low: float, high: float, classes: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
        """Full points of a range of heights and a set of classes, and the leaves (id) that were read for them.

        A leaf whose zone map (heights, classes) rules it out is not asked for; what is left prunes partitions by file and depth, and row groups by the points' own
        statistics of tile_id and z.
        """
        zone = F.col("attribute_indexes")
        may_hold = (zone["altitude"]["min"] <= high) & (zone["altitude"]["max"] >= low) & F.arrays_overlap(zone["classification_bins"], F.array(*map(F.lit, classes)))
        leaves = self.tiles().where((F.size("child_ids") <= 0) & (F.col("full_point_count") > 0) & may_hold).select("id")
        points = self._points((F.col("kind") == "full") & F.col("z").between(low, high) & F.col("classification").isin(*classes))
        return points.join(leaves.withColumnRenamed("id", "tile_id"), "tile_id", "left_semi"), leaves
