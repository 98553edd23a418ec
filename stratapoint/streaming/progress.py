"""Growing clouds and moving cameras: snapshots of tiles, debounced camera events, the selection's memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratapoint.config import Bounds, LodConfig
from stratapoint.operators.selection import by_level, descend
from stratapoint.operators.tiling import digit_columns, tile_id, with_digits

SNAPSHOT_POINTS = 100_000


def debounced(events: DataFrame, by: str, ts: str, gap: str, *keep: str) -> DataFrame:
    """The last event of each burst: events of one session less than `gap` apart. Works on batches and, with a watermark, on streams."""
    burst = events.groupBy(by, F.session_window(ts, gap).alias("_w"))
    last = burst.agg(F.max_by(F.struct(ts, *keep), F.struct(ts, *keep)).alias("_last"), F.count(F.lit(1)).alias("events"))
    return last.select(by, "_last.*", "events")


def progressive_tiles(points: DataFrame, bounds: Bounds, depth: int) -> DataFrame:
    """Running counts and heights of every tile, for a stream of points in update mode or for a batch."""
    digits = digit_columns(depth)
    rows = with_digits(points, bounds, depth)
    ids = F.array(*(tile_id(bounds, digits[:level]) for level in range(depth + 1)))
    tiles = rows.select(F.posexplode(ids).alias("depth", "id"), "file_index", "z")
    return tiles.groupBy("file_index", "depth", "id").agg(F.count(F.lit(1)).alias("full_count"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def start_progressive(
    points: DataFrame, bounds: Bounds, depth: int, on_tiles: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "300 milliseconds"
) -> StreamingQuery:
    """Hands the tiles that changed to on_tiles at each interval, for an upsert into a store, say; without an interval all that is there, then it ends.

    Batches are handed over in order, and an error of on_tiles ends the query.
    """
    writer = progressive_tiles(points, bounds, depth).writeStream.outputMode("update").foreachBatch(on_tiles).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def snapshots(points: DataFrame, bounds: Bounds, depth: int, every: int = SNAPSHOT_POINTS) -> DataFrame:
    """What a progressive load shows after every `every` points of a file and at its end: each tile's count at that time.

    points carry `arrival`, their place in their file from 0. Counts are summed for each (tile, step) first; only these sums meet in a window.
    """
    digits = digit_columns(depth)
    rows = with_digits(points, bounds, depth).withColumn("step", F.floor(F.col("arrival") / every).cast("long"))
    ids = F.array(*(tile_id(bounds, digits[:level]) for level in range(depth + 1)))
    per_step = rows.select("file_index", "step", F.posexplode(ids).alias("depth", "id")).groupBy("file_index", "step", "depth", "id").agg(F.count(F.lit(1)).alias("added"))
    running = Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("file_index").agg(F.max("step").alias("_last"))
    return per_step.withColumn("count", F.sum("added").over(running)).join(F.broadcast(last), "file_index").withColumn("is_final", F.col("step") == F.col("_last")).drop("_last")


def progress_events(files: DataFrame, every: int = 5_000) -> DataFrame:
    """After how many points each file's load reports: at every `every` points and at its end. files: file_index, n."""
    steps = F.when(F.col("n") >= every, F.sequence(F.lit(every).cast("long"), F.col("n"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<long>"))
    told = F.array_distinct(F.concat(steps, F.array("n")))
    return files.select("file_index", F.explode(told).alias("processed"), "n").withColumn("is_final", F.col("processed") == F.col("n"))


def not_stale(results: DataFrame, session: str, refresh: str, order: list[str]) -> DataFrame:
    """Results that no newer one of their session came before, in order of arrival: a late answer to an old request is dropped."""
    before = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("_newest", F.max(refresh).over(before)).where(F.col("_newest").isNull() | (F.col(refresh) >= F.col("_newest"))).drop("_newest")


class Selector:
    """Selections that remember which tiles were open, one camera of each session at a time.

    A tile that is not reached in one selection is forgotten by the next. The open tiles are kept as a table, so a
    selection is a plan over two tables; `foreach_batch` lets a stream of cameras drive it.
    """

    def __init__(self, tiles: DataFrame, config: LodConfig, accumulate: bool, store: Callable[[DataFrame], DataFrame]):
        self.tiles, self.config, self.accumulate, self.store = tiles, config, accumulate, store
        self.open: DataFrame | None = None

    def reset(self) -> None:
        self.open = None

    def select(self, cameras: DataFrame) -> DataFrame:
        """cameras: one row for each camera_id, the session's camera now."""
        out = self.store(descend(by_level(self.tiles), cameras, self.config, self.accumulate, lambda df, _: self.store(df), self.open))
        now = out.where("expanded").select("camera_id", "id")
        self.open = now if self.open is None else now.union(self.open.join(cameras.select("camera_id"), "camera_id", "left_anti"))
        self.open = self.store(self.open)
        return out

    def foreach_batch(self, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For a stream of cameras: within a batch the last camera of each session counts. cameras carry ts."""

        def run(batch: DataFrame, batch_id: int) -> None:
            newest = Window.partitionBy("camera_id").orderBy(F.desc("ts"))
            then(self.select(batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")), batch_id)

        return run
