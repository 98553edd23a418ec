"""What streams remember: the newest refresh of a session, its open tiles, the growing samples of tiles.

State lives in Spark's state store under a checkpoint, so a stream that starts again goes on where it stopped. Each state has a fixed size for its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratapoint.config import Bounds
from stratapoint.operators.tiling import Forest, digit_columns, tile_id, with_digits

#: A tile is shown again once so many points have come to its file and so many milliseconds have gone by.
SNAPSHOT_POINTS, SNAPSHOT_MS = 100_000, 300


def fresh_results(results: DataFrame, session: str, refresh: str, order: list[str]) -> DataFrame:
    """Of a stream of results, those that no newer one of their session came before, within a batch in order of `order`. State: the newest refresh id."""
    columns = results.columns

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(order, kind="stable")
        best = rows[refresh].cummax()
        before = best.shift(1)
        if newest is not None:
            before = before.fillna(newest).clip(lower=newest)
        state.update((int(max(best.iloc[-1], newest if newest is not None else best.iloc[-1])),))
        yield rows[before.isna() | (rows[refresh] >= before)][columns]

    return results.groupBy(session).applyInPandasWithState(keep, results.schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def growing_samples(points: DataFrame, bounds: Bounds | Forest, depth: int, size: int, seed: int = 7) -> DataFrame:
    """For a stream of points (file_index, point_index, mx, my, z, classification): each tile that a batch has reached, with its count, heights and sample so far.

    State of a tile: count, least and greatest height and the `size` points whose seeded hash comes first, which are a fair sample of all that have come. The sample of
    `load.tile_samples` over the same points is the same.
    """
    digits = digit_columns(depth)
    ids = F.array(*(tile_id(bounds, digits[:level]) for level in range(depth + 1)))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("point_index").cast("string")).cast("binary"))
    rows = with_digits(points, bounds, depth).select("file_index", "point_index", "z", hashed.alias("hash"), F.posexplode(ids).alias("depth", "tile_id"))
    out = T.StructType([T.StructField(n, t) for n, t in (
        ("tile_id", T.StringType()), ("file_index", T.IntegerType()), ("depth", T.IntegerType()), ("full_count", T.LongType()), ("min_z", T.DoubleType()), ("max_z", T.DoubleType()), ("sample", T.ArrayType(T.LongType())),
    )])

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, low, high, sample, hashes = state.get if state.exists else (0, float("inf"), float("-inf"), [], [])
        held = list(zip(hashes, sample))
        for rows in batches:
            count, low, high = count + len(rows), min(low, rows["z"].min()), max(high, rows["z"].max())
            held = sorted([*held, *zip(rows["hash"].tolist(), rows["point_index"].tolist())])[:size]
        sample = [p for _, p in held]
        state.update((int(count), float(low), float(high), sample, [h for h, _ in held]))
        yield pd.DataFrame({"tile_id": [key[2]], "file_index": [key[0]], "depth": [key[1]], "full_count": [count], "min_z": [low], "max_z": [high], "sample": [sample]})

    kept = "count long, low double, high double, sample array<long>, hashes array<string>"
    return rows.groupBy("file_index", "depth", "tile_id").applyInPandasWithState(grow, out, kept, "update", GroupStateTimeout.NoTimeout)


def due_snapshots(arrivals: DataFrame, every: int = SNAPSHOT_POINTS, least_ms: int = SNAPSHOT_MS) -> DataFrame:
    """For a stream of arrivals (file_index, ts, points, is_last): when a file's tiles are shown again.

    A snapshot is due once at least `every` points have come since the last one and `least_ms` milliseconds have gone by, both; and at a file's end. Its row tells the time and all
    points so far. State of a file: points, those since the last snapshot, its time.
    """
    out = "file_index int, ts timestamp, points long, is_final boolean"

    def tell(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, since, last = state.get if state.exists else (0, 0, None)
        told = []
        for ts, n, end in pd.concat(batches).sort_values("ts", kind="stable")[["ts", "points", "is_last"]].itertuples(index=False):
            ms = int(ts.value // 1_000_000)
            last = ms if last is None else last
            total, since = total + n, since + n
            if end or (since >= every and ms - last >= least_ms):
                told.append((key[0], ts, total, bool(end)))
                since, last = 0, ms
        state.update((int(total), int(since), last))
        yield pd.DataFrame(told, columns=["file_index", "ts", "points", "is_final"])

    return arrivals.groupBy("file_index").applyInPandasWithState(tell, out, "total long, since long, last long", "append", GroupStateTimeout.NoTimeout)
