"""Which tiles a camera needs: visibility, refinement with hysteresis, the active set and what it lacks.

`descend` goes down level by level: only the pairs (camera, tile) that are still open join the children of their tiles, so
that nothing below a tile that lies behind a camera or is small enough is ever read for it. The descent also has a closed form, `select_tiles`: a tile is
reached if every ancestor exists, is visible and is refined; one row for each (tile, ancestor) and a conjunction over them replace the
recursion, for trees whose levels are not known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapoint.config import LodConfig
from stratapoint.functions import camera as cam
from stratapoint.functions.projection import to_metric


#: Rows that are sent to all tasks, at most.
SENT_ROWS = 100_000
PLANE = ["crs_kind", "crs_zone", "crs_northern"]
#: Digits of a child's position among its siblings.
POSITION = 2


def sent_if_few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(SENT_ROWS + 1)) <= SENT_ROWS else df


def placed(cameras: DataFrame, planes: DataFrame) -> DataFrame:
    """Cameras in the plane of each CRS in use (there are few): position `_at`, and where they look, `_fx` and `_fy`."""
    z = cam.altitude(F.col("lat"), F.col("zoom"), F.col("pitch"), F.col("viewport_height"), F.col("fov_degrees"))
    at = cameras.join(sent_if_few(planes)).withColumn("_z", z).withColumn("_c", to_metric(F.col("lng"), F.col("lat"), *(F.col(c) for c in PLANE)))
    at = at.withColumn("_at", cam.ground_position(F.col("_c.x"), F.col("_c.y"), F.col("_z"), F.col("pitch"), F.col("bearing")))
    return at.select("camera_id", "pitch", "_at", (F.col("_c.x") - F.col("_at.x")).alias("_fx"), (F.col("_c.y") - F.col("_at.y")).alias("_fy"), *PLANE)


def looked_at(both: DataFrame) -> DataFrame:
    """Rows of a tile and a placed camera with distance, diagonal, angle and whether the tile lies behind."""
    b, at = F.col("bounds"), F.col("_at")
    out = both.withColumns({
        "distance": cam.distance(at, b, F.col("min_z"), F.col("max_z")),
        "diagonal": cam.diagonal(b, F.col("min_z"), F.col("max_z")),
        "behind": F.when(F.col("pitch") <= 1, False).otherwise(cam.behind(b, at["x"], at["y"], F.col("_fx"), F.col("_fy"))),
    })
    return out.withColumn("angle", cam.angular_size(F.col("diagonal"), F.col("distance")))


CAMERA = ["pitch", "_at", "_fx", "_fy"]


def seen_by(tiles: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each tile for each camera: distance, angle and whether it lies behind.

    cameras: camera_id, lng, lat, zoom, pitch, bearing, viewport_height, fov_degrees; every tile is tested against
    every camera. A camera is placed in the plane of the tile's own file, once for each CRS in use.
    """
    at = placed(cameras, tiles.select(*PLANE).distinct()).withColumnsRenamed({c: f"_p_{c}" for c in PLANE})
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in PLANE]
    both = tiles.join(sent_if_few(at), reduce(Column.__and__, same)).select("camera_id", *tiles.columns, *CAMERA)
    return looked_at(both).drop(*CAMERA)


def by_level(tiles: DataFrame) -> Callable[[int], DataFrame]:
    """The tiles of one depth of a table."""
    return lambda depth: tiles.where(F.col("depth") == depth)


def descend(
    level: Callable[[int], DataFrame], cameras: DataFrame, config: LodConfig, accumulate: bool, store: Callable[[DataFrame, str], DataFrame],
    previous: DataFrame | None = None, on_level: Callable[[int, int, int], None] | None = None,
) -> DataFrame:
    """The tiles that each camera reaches, with distance, angle, `expanded`, `active` and `way`, by which they sort in the order of a depth-first walk.

    level: gives the tiles of a depth, as TileStore.tiles does. Roots meet all cameras; below them only the pairs still open join the next level's tiles by
    their parent. previous: camera_id and id of the tiles that were open before; they stay open a little longer. on_level is told
    the depth, the open pairs that asked and the tiles that were read for them.
    """
    roots = level(0)
    at = store(placed(cameras, roots.select(*PLANE).distinct()), "cameras").withColumnsRenamed({c: f"_p_{c}" for c in PLANE})
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in PLANE]
    first = sent_if_few(roots.where("parent_id IS NULL"))
    pairs = at.join(first, reduce(Column.__and__, same)).drop(*(f"_p_{c}" for c in PLANE)).withColumn("way", F.lpad(F.col("file_index").cast("string"), 10, "0"))
    levels, depth = [], 0
    while True:
        pairs = looked_at(pairs)
        if previous is not None:
            before = previous.select("camera_id", "id").distinct().withColumn("_was", F.lit(True))
            pairs = pairs.join(before, ["camera_id", "id"], "left")
            was = F.coalesce("_was", F.lit(False))
        else:
            was = F.lit(False)
        open_ = F.coalesce(refined(F.col("angle"), was, config), F.lit(False)) & ~F.col("behind") & (F.size("child_ids") > 0)
        pairs = store(pairs.withColumn("_open", open_).drop("_was"), f"pairs-{depth}")
        levels.append(pairs)
        asked = pairs.where("_open").select("camera_id", F.col("id").alias("parent_id"), *CAMERA, F.col("way").alias("_way"), F.col("child_ids").alias("_siblings"))
        if asked.isEmpty():
            break
        depth += 1
        wanted = level(depth).join(asked.select("parent_id").distinct(), "parent_id", "left_semi")
        if on_level:
            on_level(depth, asked.count(), wanted.count())
        place = F.lpad((F.array_position("_siblings", F.col("id")) - 1).cast("string"), POSITION, "0")
        pairs = asked.join(wanted, "parent_id").withColumn("way", F.concat_ws(".", "_way", place)).drop("_way", "_siblings")
    out = []
    for k, own in enumerate(levels):
        if k + 1 < len(levels):
            kids = levels[k + 1].groupBy("camera_id", F.col("parent_id").alias("id")).agg(F.bool_or(~F.col("behind")).alias("_kid"))
            own = own.join(kids, ["camera_id", "id"], "left")
        else:
            own = own.withColumn("_kid", F.lit(None).cast("boolean"))
        own = own.withColumn("expanded", F.col("_open") & F.col("_kid").isNotNull())
        stays = F.lit(True) if accumulate else ~F.col("expanded") | ~F.col("_kid")
        out.append(own.withColumn("active", ~F.col("behind") & stays).drop("_open", "_kid", *CAMERA))
    return reduce(DataFrame.unionByName, out)


#: Pairs of a camera and a root that a task goes down with at once.
VIEWS = 2_048


def _views(tree: dict[str, np.ndarray], own: pd.DataFrame, config: LodConfig, accumulate: bool) -> np.ndarray:
    """active, points, reached and expanded of placed cameras (x, y, z, pitch, fx, fy, plane), one level of the tree after the other."""
    x, y, z, pitch, fx, fy = (own[c].to_numpy(np.float64) for c in ("x", "y", "z", "pitch", "fx", "fy"))
    z = np.where(np.isnan(z), 0.0, z)
    out = np.zeros((4, len(own)), np.int64)
    who, tile = np.nonzero(own["plane"].to_numpy()[:, None] == tree["plane"][None, : tree["roots"]])
    opened = above = None
    while len(who):
        lo_x, hi_x, lo_y, hi_y, lo_z, hi_z, wide, n, kids = (tree[c][tile] for c in ("min_x", "max_x", "min_y", "max_y", "low", "high", "diagonal", "n", "kids"))
        at_x, at_y, at_z, to_x, to_y = x[who], y[who], z[who], fx[who], fy[who]
        off = [np.maximum(np.maximum(lo - v, v - hi), 0.0) for v, lo, hi in ((at_x, lo_x, hi_x), (at_y, lo_y, hi_y), (at_z, lo_z, hi_z))]
        across = np.sqrt(off[0] * off[0] + off[1] * off[1])
        far = np.sqrt(across * across + off[2] * off[2])
        angle = np.degrees(2 * np.arctan(wide / (np.where((far > 0) & (far < np.inf), far, 1.0) * 2)))
        angle = np.where(~((wide > 0) & (wide < np.inf)), 0.0, np.where(far == 0, np.inf, np.where((far > 0) & (far < np.inf), angle, 0.0)))
        most = np.maximum.reduce([(a - at_x) * to_x + (b - at_y) * to_y for a in (lo_x, hi_x) for b in (lo_y, hi_y)])
        behind = ~(pitch[who] <= 1) & (most <= 0) & ((to_x != 0) | (to_y != 0))
        if opened is not None:  # an open tile is active if all show, or none of its children does
            shown = np.bincount(above[~behind], minlength=len(opened[0])) > 0
            stays = np.ones(len(shown), bool) if accumulate else ~shown
            np.add.at(out[0], opened[0][stays], 1)
            np.add.at(out[1], opened[0][stays], opened[1][stays])
        open_ = ~behind & (angle >= config.threshold_degrees) & (kids > 0)
        closed = ~behind & ~open_
        out[2] += np.bincount(who, minlength=len(own))
        out[3] += np.bincount(who[open_], minlength=len(own))
        out[0] += np.bincount(who[closed], minlength=len(own))
        np.add.at(out[1], who[closed], n[closed])
        opened, kids, first = (who[open_], n[open_]), kids[open_], tree["first"][tile[open_]]
        above = np.repeat(np.arange(len(kids)), kids)
        who, tile = opened[0][above], first[above] + np.arange(len(above)) - np.repeat(np.cumsum(kids) - kids, kids)
    return out


def figures(tiles: DataFrame, cameras: DataFrame, config: LodConfig, accumulate: bool, store: Callable[[DataFrame, str], DataFrame], count: str = "original_point_count") -> DataFrame:
    """For each camera the number of tiles that `descend` finds active, their points by `count`, and the tiles reached and expanded.

    For many cameras over a tree of SENT_ROWS tiles at most: the tree's boxes are sent to all tasks, and the cameras of a batch go down together. No pair of camera
    and tile leaves its task. With a larger tree the pairs are those of `descend`.
    """
    if len(tiles.select(F.lit(1)).take(SENT_ROWS + 1)) > SENT_ROWS:
        picked = descend(by_level(tiles.select("id", "parent_id", "child_ids", "file_index", "depth", "bounds", "min_z", "max_z", count, *PLANE)), cameras, config, accumulate, store)
        shown = F.col("active")
        return picked.groupBy("camera_id").agg(F.count_if(shown).alias("active"), F.coalesce(F.sum(F.when(shown, F.col(count))), F.lit(0)).alias("points"), F.count(F.lit(1)).alias("reached"), F.count_if("expanded").alias("expanded"))
    b, (low, high) = F.col("bounds"), cam.vertical_bounds(F.col("bounds"), F.col("min_z"), F.col("max_z"))
    plane = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in PLANE))
    narrow = tiles.select(
        "id", "parent_id", "depth", plane.alias("plane"), *(b[e].alias(e) for e in ("min_x", "max_x", "min_y", "max_y")), low.alias("low"), high.alias("high"),
        cam.diagonal(b, F.col("min_z"), F.col("max_z")).alias("diagonal"), F.col(count).alias("n"),
    ).where("parent_id IS NULL OR depth > 0").toPandas()  # SENT_ROWS at most
    # Level by level, children of one tile side by side.
    narrow = narrow.sort_values(["depth", "parent_id", "id"], na_position="first", kind="stable").reset_index(drop=True)
    below = narrow.reset_index().groupby("parent_id")["index"].agg(["min", "count"]).reindex(narrow["id"])
    tree = {c: narrow[c].to_numpy() for c in narrow.columns if c not in ("id", "parent_id", "depth")}
    tree |= {"kids": below["count"].fillna(0).to_numpy(np.int64), "first": below["min"].fillna(0).to_numpy(np.int64), "roots": int((narrow["depth"] == 0).sum())}
    sent = tiles.sparkSession.sparkContext.broadcast(tree)
    at = placed(cameras, tiles.where("depth = 0").select(*PLANE).distinct())
    at = at.select("camera_id", "pitch", *(F.col(f"_at.{a}").alias(a) for a in "xyz"), F.col("_fx").alias("fx"), F.col("_fy").alias("fy"), plane.alias("plane"))
    names = ("active", "points", "reached", "expanded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, VIEWS // max(1, sent.value["roots"]))
        for batch in batches:
            for i in range(0, len(batch), step):
                own = batch.iloc[i : i + step]
                yield pd.DataFrame({"camera_id": own["camera_id"].to_numpy(), **dict(zip(names, _views(sent.value, own, config, accumulate)))})

    parts = max(2 * tiles.sparkSession.sparkContext.defaultParallelism, -(-cameras.count() // 20_000))
    out = at.repartition(parts).mapInPandas(run, f"camera_id {cameras.schema['camera_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}")
    return out.groupBy("camera_id").agg(*(F.sum(n).alias(n) for n in names)).where("reached > 0")


def ranked(picked: DataFrame) -> DataFrame:
    """The active tiles of each camera with `rank`, their place from 1 in a depth-first walk; the tiles of one camera are a bounded set."""
    order = Window.partitionBy("camera_id").orderBy("way")
    return picked.where("active").withColumn("rank", F.row_number().over(order))


def refined(angle: Column, was_expanded: Column, config: LodConfig) -> Column:
    """Whether a tile is wide enough to show its children instead; an open tile stays open a little longer."""
    return angle >= F.when(was_expanded, config.threshold_degrees * (1 - config.hysteresis)).otherwise(config.threshold_degrees)


def ancestors(tiles: DataFrame, by: list[str], max_depth: int = 16) -> DataFrame:
    """(id, ancestor, up) for all strict ancestors of each tile, by following parent_id up to max_depth times.

    `by` are columns that a tile and its ancestors share. Trees are shallow; each step joins the rows still climbing.
    """
    parent = tiles.select(*by, F.col("id").alias("ancestor"), F.col("parent_id").alias("_next"))
    level = tiles.where("parent_id IS NOT NULL").select(*by, "id", F.col("parent_id").alias("ancestor"))
    out = level.withColumn("up", F.lit(1))
    for up in range(2, max_depth + 1):
        level = level.join(parent, [*by, "ancestor"]).where("_next IS NOT NULL").select(*by, "id", F.col("_next").alias("ancestor"))
        out = out.union(level.withColumn("up", F.lit(up)))
    return out


def path_ancestors(tiles: DataFrame, by: list[str]) -> DataFrame:
    """The same for ids that are dotted paths, from the id alone: no join."""
    parts = F.split("id", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))
    rows = tiles.where("parent_id IS NOT NULL").select(*by, "id", F.posexplode(above).alias("_p", "ancestor"), F.size(parts).alias("_n"))
    return rows.select(*by, "id", "ancestor", (F.col("_n") - 1 - F.col("_p")).alias("up"))


def select_tiles(tiles: DataFrame, visible: Column, expand: Column, accumulate: bool, by: list[str] | None = None, dotted: bool = True, max_depth: int = 16) -> DataFrame:
    """tiles with `reached`, `expanded` and `active`. A forest of its own for each value of the columns `by`.

    accumulate: every visible tile on the way is active (octree); otherwise a refined tile gives way to its visible children
    (quadtree), unless none is visible. Children that have no row are ignored.
    """
    by = by or []
    flags = tiles.withColumns({"_visible": F.coalesce(visible, F.lit(False)), "_expand": F.coalesce(expand, F.lit(False))})
    up = path_ancestors(tiles, by) if dotted else ancestors(tiles, by, max_depth)
    open_tiles = flags.select(*by, F.col("id").alias("ancestor"), (F.col("_visible") & F.col("_expand")).alias("_open"))
    way = up.join(open_tiles, [*by, "ancestor"], "left").groupBy(*by, "id").agg(F.bool_and(F.coalesce("_open", F.lit(False))).alias("_way"))
    kids = flags.where("parent_id IS NOT NULL").groupBy(*by, F.col("parent_id").alias("id")).agg(F.bool_or("_visible").alias("_child_visible"))
    out = flags.join(way, [*by, "id"], "left").join(kids, [*by, "id"], "left")
    has_children = F.col("_child_visible").isNotNull()
    reached = F.coalesce("_way", F.lit(True)) & F.when(F.col("parent_id").isNotNull(), F.col("_way").isNotNull()).otherwise(True)
    out = out.withColumn("reached", reached).withColumn("expanded", F.col("reached") & F.col("_visible") & has_children & F.col("_expand"))
    stays = F.lit(True) if accumulate else ~has_children | ~F.col("_expand") | ~F.coalesce("_child_visible", F.lit(False))
    return out.withColumn("active", F.col("reached") & F.col("_visible") & stays).drop("_visible", "_expand", "_way", "_child_visible")


def select_for_cameras(tiles: DataFrame, cameras: DataFrame, config: LodConfig, accumulate: bool, previous: DataFrame | None = None) -> DataFrame:
    """The selection of each camera. previous: camera_id and id of the tiles that were open before."""
    seen = seen_by(tiles, cameras)
    if previous is not None:
        seen = seen.join(previous.select("camera_id", "id").distinct().withColumn("_was", F.lit(True)), ["camera_id", "id"], "left")
        was = F.coalesce("_was", F.lit(False))
    else:
        was = F.lit(False)
    return select_tiles(seen, ~F.col("behind"), refined(F.col("angle"), was, config), accumulate, ["camera_id"])


def fetched(store, wanted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id and points of what the store holds of wanted (id, source), beside what is known already."""
    got = store.get_many(wanted).groupBy(F.col("tile_id").alias("id")).agg(F.count(F.lit(1)).alias("points"))
    return got if known is None else known.unionByName(got)


def refresh(
    store, cameras: DataFrame, config: LodConfig, accumulate: bool, keep: Callable[[DataFrame, str], DataFrame], resident: DataFrame | None = None, previous: DataFrame | None = None,
    again: Callable[[], None] = lambda: None, fetch: Callable[..., DataFrame] = fetched,
) -> dict[str, DataFrame]:
    """One refresh of what each camera shows, from the tiles and points of a store to what is drawn.

    Selects by descent, describes the active tiles, fetches those not resident under the same key, fetches what is missing once more after `again` (a pause, say), and
    reconciles. resident: camera_id, id, render_key and points of what is drawn now; previous: camera_id and id of the open tiles. Returns tables: `drawn`, the next resident;
    `actions` (camera_id, id, action: keep, replace, create or delete); `missing` (camera_id, id); `pending` (camera_id, id), the open parents over what is missing; `totals` by camera;
    `open`, the next previous.
    """
    spark = cameras.sparkSession
    resident = resident if resident is not None else spark.createDataFrame([], f"camera_id {cameras.schema['camera_id'].dataType.simpleString()}, id string, render_key string, points long")
    picked = keep(descend(store.tiles, cameras, config, accumulate, keep, previous), "picked")
    described = keep(descriptors(ranked(picked)).select("camera_id", "id", "parent_id", "rank", "source", "render_count", "render_key", "source_point_count"), "described")
    held = resident.select("camera_id", "id", "render_key", F.col("points").alias("_held"))
    state = described.join(held, ["camera_id", "id", "render_key"], "left")
    wanted = keep(state.where("_held IS NULL").select("id", "source").distinct(), "wanted")
    payload = keep(fetch(store, wanted), "payload")
    left = wanted.join(payload.select("id"), "id", "left_anti")
    if not left.isEmpty():
        again()
        payload = keep(fetch(store, left, payload), "payload-again")
    state = keep(state.join(payload, "id", "left").withColumn("points", F.coalesce("points", "_held")).drop("_held"), "state")
    drawn = keep(state.where("points > 0").select("camera_id", "id", "render_key", "points"), "drawn")
    both = drawn.select("camera_id", "id", F.col("render_key").alias("_new")).join(resident.select("camera_id", "id", F.col("render_key").alias("_old")), ["camera_id", "id"], "full_outer")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "create").when(F.col("_new") == F.col("_old"), "keep").otherwise("replace")
    missing_now = state.where("points IS NULL").select("camera_id", "id", "parent_id")
    totals = state.groupBy("camera_id").agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("points"), F.lit(0)).alias("rendered"), F.sum("source_point_count").alias("available"))
    opened = picked.where("expanded").select("camera_id", "id")
    # What is missing was reached, so all above it are open: its nearest open ancestor is its parent.
    pending = missing_now.where("parent_id IS NOT NULL").select("camera_id", F.col("parent_id").alias("id")).distinct()
    return {
        "drawn": drawn, "actions": both.select("camera_id", "id", action.alias("action")), "missing": missing_now.select("camera_id", "id"), "pending": pending,
        "totals": totals, "open": opened,
    }


def descriptors(tiles: DataFrame, full_resolution: bool = True) -> DataFrame:
    """What to draw of each tile: its full points if it is a leaf that has them, else its sample."""
    full = F.lit(full_resolution) & (F.size("child_ids") <= 0) & (F.col("full_point_count") > 0)
    out = tiles.withColumn("source", F.when(full, "full").otherwise("sample"))
    out = out.withColumn("render_count", F.when(F.col("source") == "full", F.col("full_point_count")).otherwise(F.coalesce("sampled_point_count", F.lit(0))))
    return out.withColumn("render_key", F.concat_ws(":", "id", "source", F.col("render_count").cast("string")))


def fetch_list(described: DataFrame, resident: DataFrame) -> DataFrame:
    """Tiles to fetch: those not resident under the same key."""
    return described.join(resident.select("id", "render_key"), ["id", "render_key"], "left_anti")


def missing(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    return requested.join(fetched.select("id"), "id", "left_anti")


def residency(described: DataFrame, resident: DataFrame) -> DataFrame:
    """keep, replace, create or delete for each tile wanted or resident."""
    both = described.select("id", F.col("render_key").alias("new_key")).join(resident.select("id", F.col("render_key").alias("old_key")), "id", "full_outer")
    action = (
        F.when(F.col("new_key").isNull(), "delete").when(F.col("old_key").isNull(), "create").when(F.col("new_key") == F.col("old_key"), "keep").otherwise("replace")
    )
    return both.withColumn("action", action)


def pending_parents(pending: DataFrame, tiles: DataFrame, expanded: DataFrame) -> DataFrame:
    """The nearest open ancestor of each pending tile, each once. A climb ends where a parent has no row."""
    own = tiles.join(pending.select("id"), "id", "left_semi")
    there = tiles.select(F.col("id").alias("ancestor"), F.lit(1).alias("_there"))
    open_tiles = expanded.select(F.col("id").alias("ancestor")).distinct().withColumn("_open", F.lit(1))
    up = path_ancestors(own, []).join(there, "ancestor", "left").join(open_tiles, "ancestor", "left")
    stops = up.groupBy("id").agg(F.min(F.when(F.col("_there").isNull(), F.col("up"))).alias("gap"), F.min(F.when(F.col("_open").isNotNull(), F.struct("up", "ancestor"))).alias("near"))
    found = stops.where("near IS NOT NULL AND (gap IS NULL OR near.up < gap)")
    return found.select(F.col("near.ancestor").alias("id")).distinct()


def highlighted(tiles: DataFrame, pending: DataFrame) -> DataFrame:
    """The tiles to draw a box around: those in pending."""
    return tiles.join(pending.select("id"), "id", "left_semi")


def renderable(described: DataFrame, payload: DataFrame, resident: DataFrame) -> DataFrame:
    """Tiles that can be drawn: those whose payload (id, points) has points, and those already resident under the same key."""
    have = payload.select("id", F.col("points").alias("_points"))
    same = resident.select("id", "render_key", F.lit(True).alias("_same"))
    out = described.join(have, "id", "left").join(same, ["id", "render_key"], "left")
    return out.where((F.coalesce("_points", F.lit(0)) > 0) | F.col("_same")).withColumn("points", F.coalesce("_points", F.lit(0))).drop("_points", "_same")


def with_crs_of_file(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """tiles with the CRS of their file, or their own where the file has no row. files: file_index, crs_kind, crs_code, crs_zone, crs_northern; as many rows as files."""
    names = ("crs_kind", "crs_code", "crs_zone", "crs_northern")
    known = files.select("file_index", *(F.col(n).alias(f"_{n}") for n in names), F.lit(True).alias("_known"))
    out = tiles.join(known, "file_index", "left")
    return out.withColumns({n: F.when(F.col("_known"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}).drop("_known", *(f"_{n}" for n in names))


def active_totals(described: DataFrame, by: list[str]) -> DataFrame:
    """Points drawn and points available in an active set; available counts overlap across levels."""
    return described.groupBy(*by).agg(F.count(F.lit(1)).alias("tiles"), F.sum("render_count").alias("rendered"), F.sum("source_point_count").alias("available"))
