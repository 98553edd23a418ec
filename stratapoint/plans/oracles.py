"""The SQL that each query of the point-cloud engine must equal, for an engine with ANSI SQL, lists and recursion.

Written from the definitions, not from the operators: tiles by grouping on each level, selection by recursion.
"""

from __future__ import annotations

import math

A, F_, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = F_ * (2 - F_)
EP2 = E2 / (1 - E2)
N = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
M0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
M2, M4, M6 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072
J1, J2, J3, J4 = 3 * N / 2 - 27 * N**3 / 32, 21 * N**2 / 16 - 55 * N**4 / 32, 151 * N**3 / 96, 1097 * N**4 / 512
LON0 = math.radians((28 - 1) * 6 - 180 + 3)
DEPTH = 6


def d(x: float) -> str:
    return f"({x!r}::DOUBLE)"


RAW = """raw AS (
  SELECT cast(l_suppkey % 2 AS INT) AS file_index,
    l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS point_index,
    cast((l_partkey * 7919 + l_orderkey * 104729) % 400000 AS INT) AS raw_x,
    cast((l_suppkey * 6151 + l_orderkey * 15485863) % 400000 AS INT) AS raw_y,
    cast((cast(l_quantity AS BIGINT) * 977 + l_linenumber * 131) % 30000 AS INT) AS raw_z,
    cast(CASE WHEN l_partkey % 97 = 0 THEN 64 ELSE l_linenumber + 1 END AS INT) AS classification
  FROM lineitem
)"""
POINTS = RAW + """, points AS (
  SELECT file_index, point_index, classification,
    raw_x * 0.01::DOUBLE + 456000.0::DOUBLE AS x, raw_y * 0.01::DOUBLE + 3110000.0::DOUBLE AS y, raw_z * 0.01::DOUBLE AS z
  FROM raw
)"""  # fmt: skip

EVENT_CAMERAS = """cams AS (
  SELECT event_id AS camera_id, user_id AS session_id, ts, -15.45::DOUBLE + (user_id % 50) * 0.001::DOUBLE AS lng,
    28.10::DOUBLE + (event_id % 50) * 0.001::DOUBLE AS lat, (12 + event_id % 7)::DOUBLE AS zoom,
    ((event_id * 13) % 86)::DOUBLE AS pitch, ((user_id * 37) % 360)::DOUBLE AS bearing FROM events
)"""
TYPE_CAMERAS = """sums AS (SELECT event_type, sum(user_id)::BIGINT AS u, sum(event_id)::BIGINT AS e, count(*) AS n FROM events GROUP BY 1),
cams AS (
  SELECT event_type AS camera_id, -15.45::DOUBLE + (u % 50) * 0.001::DOUBLE AS lng, 28.10::DOUBLE + (e % 50) * 0.001::DOUBLE AS lat,
    (12 + n % 5)::DOUBLE AS zoom, ((e * 13 + n) % 86)::DOUBLE AS pitch, ((u * 37) % 360)::DOUBLE AS bearing FROM sums
)"""


def inverse(src: str, out: str, x: str = "x", y: str = "y") -> str:
    """CTEs: out is src with lng and lat of the UTM 28N position x, y."""
    return f"""{out}_1 AS (SELECT *, {y} / ({d(K0 * A * M0)}) AS mu FROM {src}),
{out}_2 AS (SELECT *, mu + {d(J1)} * sin(2 * mu) + {d(J2)} * sin(4 * mu) + {d(J3)} * sin(6 * mu) + {d(J4)} * sin(8 * mu) AS fp FROM {out}_1),
{out}_3 AS (SELECT *, {d(EP2)} * cos(fp) * cos(fp) AS c1, tan(fp) * tan(fp) AS t1, {d(A)} / sqrt(1 - {d(E2)} * sin(fp) * sin(fp)) AS n1,
  {d(A * (1 - E2))} / pow(1 - {d(E2)} * sin(fp) * sin(fp), 1.5::DOUBLE) AS r1 FROM {out}_2),
{out}_4 AS (SELECT *, ({x} - 500000) / (n1 * {d(K0)}) AS dd FROM {out}_3),
{out} AS (SELECT * EXCLUDE (mu, fp, c1, t1, n1, r1, dd),
  degrees({d(LON0)} + (dd - (1 + 2 * t1 + c1) * pow(dd, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + {d(8 * EP2)} + 24 * t1 * t1) * pow(dd, 5) / 120) / cos(fp)) AS lng,
  degrees(fp - n1 * tan(fp) / r1 * (dd * dd / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - {d(9 * EP2)}) * pow(dd, 4) / 24
    + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - {d(252 * EP2)} - 3 * c1 * c1) * pow(dd, 6) / 720)) AS lat FROM {out}_4)"""


def forward(src: str, out: str) -> str:
    """CTEs: out is src with ux and uy, the UTM 28N position of lng, lat."""
    return f"""{out}_1 AS (SELECT *, radians(lat) AS ph FROM {src}),
{out}_2 AS (SELECT *, {d(A)} / sqrt(1 - {d(E2)} * sin(ph) * sin(ph)) AS nn, tan(ph) * tan(ph) AS tt, {d(EP2)} * cos(ph) * cos(ph) AS cc,
  (radians(lng) - {d(LON0)}) * cos(ph) AS aa,
  {d(A)} * ({d(M0)} * ph - {d(M2)} * sin(2 * ph) + {d(M4)} * sin(4 * ph) - {d(M6)} * sin(6 * ph)) AS arc FROM {out}_1),
{out} AS (SELECT * EXCLUDE (ph, nn, tt, cc, aa, arc),
  {d(K0)} * nn * (aa + (1 - tt + cc) * pow(aa, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * cc - {d(58 * EP2)}) * pow(aa, 5) / 120) + 500000 AS ux,
  {d(K0)} * (arc + nn * tan(ph) * (aa * aa / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * pow(aa, 4) / 24
    + (61 - 58 * tt + tt * tt + 600 * cc - {d(330 * EP2)}) * pow(aa, 6) / 720)) AS uy FROM {out}_2)"""


def digits(solid: bool, depth: int = DEPTH, src: str = "points") -> str:
    """CTEs: lv{depth} is src with id0 to id{depth} and the box of each."""
    axes = [("x", 1, 456000.0, 460000.0), ("y", 2, 3110000.0, 3114000.0)] + ([("z", 4, 0.0, 300.0)] if solid else [])
    root = "m3no" if solid else "r"
    first = ", ".join(f"{d(lo)} AS lo_{a}, {d(hi)} AS hi_{a}" for a, _, lo, hi in axes)
    out = [f"lv0 AS (SELECT *, file_index::VARCHAR || ':{root}' AS id0, {first} FROM {src})"]
    for k in range(1, depth + 1):
        digit = " + ".join(f"CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN {w} ELSE 0 END" for a, w, _, _ in axes)
        limits = ", ".join(
            f"CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN (lo_{a} + hi_{a}) / 2 ELSE lo_{a} END AS lo_{a}, CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN hi_{a} ELSE (lo_{a} + hi_{a}) / 2 END AS hi_{a}"
            for a, _, _, _ in axes
        )
        gone = ", ".join(f"lo_{a}, hi_{a}" for a, _, _, _ in axes)
        out.append(f"lv{k} AS (SELECT * EXCLUDE ({gone}), id{k - 1} || '.' || ({digit})::VARCHAR AS id{k}, {limits} FROM lv{k - 1})")
    return ",\n".join(out)


def tiles(solid: bool, depth: int = DEPTH) -> str:
    """CTEs: tiles(id, parent_id, file_index, depth, n, min_z, max_z, first_point, classes, box, kids) by grouping each level."""
    ids = ", ".join(f"id{k}" for k in range(depth + 1))
    axes = "xyz" if solid else "xy"
    root = {"x": (456000.0, 460000.0), "y": (3110000.0, 3114000.0), "z": (0.0, 300.0)}
    weight = {"x": 1, "y": 2, "z": 4}
    first = ", ".join(f"{d(root[a][0])} AS lo_{a}, {d(root[a][1])} AS hi_{a}" for a in axes)
    step = ", ".join(
        f"CASE WHEN (g.dg & {weight[a]}) <> 0 THEN (b.lo_{a} + b.hi_{a}) / 2 ELSE b.lo_{a} END, CASE WHEN (g.dg & {weight[a]}) <> 0 THEN b.hi_{a} ELSE (b.lo_{a} + b.hi_{a}) / 2 END"
        for a in axes
    )
    box = ", ".join(f"b.lo_{a}, b.hi_{a}" for a in axes)
    return f"""{digits(solid, depth)},
flat AS (SELECT file_index, point_index, z, classification, unnest([{ids}]) AS id, unnest(range(0, {depth + 1})) AS depth FROM lv{depth}),
grouped AS (
  SELECT id, any_value(file_index) AS file_index, any_value(depth)::INT AS depth, count(*) AS n, min(z) AS min_z, max(z) AS max_z, min(point_index) AS first_point,
    array_to_string(list_sort(list(DISTINCT classification)), ',') AS classes,
    CASE WHEN any_value(depth) > 0 THEN regexp_replace(id, '\\.[0-9]$', '') END AS parent_id,
    CASE WHEN any_value(depth) > 0 THEN right(id, 1)::INT END AS dg
  FROM flat GROUP BY id
),
boxes AS (
  SELECT id, {first} FROM grouped WHERE parent_id IS NULL
  UNION ALL
  SELECT g.id, {step} FROM boxes b JOIN grouped g ON g.parent_id = b.id
),
kids AS (SELECT parent_id AS id, string_agg(id, ',' ORDER BY first_point) AS child_ids, count(*) AS n_children FROM grouped WHERE parent_id IS NOT NULL GROUP BY 1),
tiles AS (SELECT g.*, {box}, coalesce(k.child_ids, '') AS child_ids, coalesce(k.n_children, 0) AS n_children FROM grouped g JOIN boxes b USING (id) LEFT JOIN kids k USING (id))"""


def hypot(*sides: str) -> str:
    return "sqrt(" + " + ".join(f"({s}) * ({s})" for s in sides) + ")"


FOV = d(math.radians(36.87))
ALTITUDE = f"40075016.68557849::DOUBLE * greatest(cos(radians(lat)), 0.01::DOUBLE) / (512 * pow(2::DOUBLE, zoom)) * 900 / (2 * tan({FOV} / 2) * (1 / greatest(cos(radians(pitch)), 0.28::DOUBLE)))"


def cameras_at(src: str = "cams") -> str:
    """CTEs: at(…, ux, uy, alt, px, py): cameras in UTM with altitude and ground position."""
    return f"""{forward(src, 'fw')},
alts AS (SELECT *, {ALTITUDE} AS alt FROM fw),
eye AS (SELECT *, ux - sin(radians(bearing)) * alt * tan(radians(pitch)) AS px, uy - cos(radians(bearing)) * alt * tan(radians(pitch)) AS py FROM alts)"""


def seen(solid: bool) -> str:
    """CTEs: seen: tiles for each camera with distance, diagonal, angle and behind."""
    lo, hi = ("lo_z", "hi_z") if solid else ("min_z", "max_z")
    dots = ", ".join(f"({x} - px) * (ux - px) + ({y} - py) * (uy - py)" for x in ("lo_x", "hi_x") for y in ("lo_y", "hi_y"))
    across = hypot("greatest(lo_x - px, px - hi_x, 0)", "greatest(lo_y - py, py - hi_y, 0)")
    return f"""{cameras_at()},
pairs AS (SELECT camera_id, pitch, t.*, {hypot(across, f"greatest({lo} - alt, alt - {hi}, 0)")} AS distance, {hypot("hi_x - lo_x", "hi_y - lo_y", f"{hi} - {lo}")} AS diagonal,
  pitch > 1 AND (ux <> px OR uy <> py) AND greatest({dots}) <= 0 AS behind FROM tiles t CROSS JOIN eye),
seen AS (SELECT *, CASE WHEN NOT diagonal > 0 THEN 0 WHEN distance = 0 THEN 'Infinity'::DOUBLE ELSE degrees(2 * atan(diagonal / (2 * distance))) END AS angle FROM pairs)"""


def selected(accumulate: bool, source: str = "seen", was: str = "false") -> str:
    """CTEs: picked: the rows reached by a descent from the roots, with expanded and active."""
    stays = "true" if accumulate else "(NOT has_kids OR NOT expand OR NOT kid_visible)"
    return f"""flags AS (SELECT *, NOT behind AS visible, angle >= CASE WHEN {was} THEN 13.5 ELSE 15 END AS expand FROM {source}),
kid AS (SELECT camera_id, parent_id AS id, bool_or(visible) AS kid_visible FROM flags WHERE parent_id IS NOT NULL GROUP BY ALL),
known AS (SELECT f.*, k.id IS NOT NULL AS has_kids, coalesce(kid_visible, false) AS kid_visible FROM flags f LEFT JOIN kid k USING (camera_id, id)),
reach AS (
  SELECT camera_id, id FROM known WHERE parent_id IS NULL
  UNION ALL
  SELECT c.camera_id, c.id FROM reach r JOIN known p ON p.camera_id = r.camera_id AND p.id = r.id AND p.visible AND p.expand
    JOIN known c ON c.camera_id = r.camera_id AND c.parent_id = r.id
),
picked AS (SELECT k.*, visible AND has_kids AND expand AS expanded, visible AND {stays} AS active FROM known k JOIN reach USING (camera_id, id))"""


FULL = "n_children = 0 AND full_n > 0"
COUNTED = f"counted AS (SELECT *, CASE WHEN depth = {DEPTH} THEN n ELSE 0 END AS full_n, least(n, 25000) AS sampled FROM {{}})"


def described(src: str) -> str:
    """CTEs: drawn: source, render_count and render_key for quadtree tiles."""
    return f"""{COUNTED.format(src)},
drawn AS (SELECT *, CASE WHEN {FULL} THEN 'full' ELSE 'sample' END AS source, CASE WHEN {FULL} THEN full_n ELSE sampled END AS render_count,
  id || ':' || CASE WHEN {FULL} THEN 'full' ELSE 'sample' END || ':' || (CASE WHEN {FULL} THEN full_n ELSE sampled END)::VARCHAR AS render_key FROM counted)"""


RESIDENT = """resident AS (
  SELECT id, CASE WHEN first_point % 3 = 0 THEN id || ':sample:0' ELSE render_key END AS render_key FROM (SELECT * FROM every) WHERE first_point % 2 = 0
)"""


def dec(x: str, digits: int) -> str:
    """A number with fixed decimals, from scaled integers."""
    if not digits:
        return f"floor({x} + 0.5)::BIGINT::VARCHAR"
    s = f"floor(({x}) * {10**digits} + 0.5)::BIGINT"
    return f"(({s}) // {10**digits})::VARCHAR || '.' || lpad((({s}) % {10**digits})::VARCHAR, {digits}, '0')"


def corners() -> str:
    """CTEs: ring(id, k, lng, lat): the corners of quadtree tiles."""
    pick = "CASE WHEN k IN (0, 3) THEN lo_x ELSE hi_x END AS x, CASE WHEN k IN (0, 1) THEN lo_y ELSE hi_y END AS y"
    return f"cn AS (SELECT id, k, {pick} FROM tiles, (SELECT unnest([0, 1, 2, 3]) AS k)),\n{inverse('cn', 'ring')}"


def grid_levels(depth: int, cells: int) -> str:
    """CTEs: kept(tile_id, depth, point_index) and came(tile_id, depth, n) of an octree's grid samples."""
    axes = "xyz"
    cell = lambda a: f"greatest(0, least({cells - 1}, floor(({a} - lo_{a}) / greatest(hi_{a} - lo_{a}, {d(2.0**-52)}) * {cells})))"
    off = lambda a: f"({a} - (lo_{a} + (c_{a} + 0.5) * (hi_{a} - lo_{a}) / {cells}))"
    out = []
    for k in range(depth + 1):
        src = "lv0" if not k else f"go{k - 1}"
        arrival = "point_index AS arrival" if not k else "arrival"
        out.append(f"a{k} AS (SELECT file_index, point_index, x, y, z, {arrival}, id{k} AS tile_id, lo_x, hi_x, lo_y, hi_y, lo_z, hi_z FROM {src})")
        out.append(f"b{k} AS (SELECT *, {', '.join(f'{cell(a)} AS c_{a}' for a in axes)} FROM a{k})")
        out.append(f"c{k} AS (SELECT *, {' + '.join(f'{off(a)} * {off(a)}' for a in axes)} AS d2 FROM b{k})")
        w = "PARTITION BY tile_id, c_x, c_y, c_z ORDER BY arrival"
        out.append(f"p{k} AS (SELECT *, coalesce(d2 < min(d2) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS held FROM c{k})")
        out.append(f"q{k} AS (SELECT *, min(CASE WHEN held THEN arrival END) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM p{k})")
        if k < depth:
            digit = " + ".join(f"CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN {w_} ELSE 0 END" for a, w_ in zip(axes, (1, 2, 4)))
            limits = ", ".join(
                f"CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN (lo_{a} + hi_{a}) / 2 ELSE lo_{a} END AS lo_{a}, CASE WHEN {a} >= (lo_{a} + hi_{a}) / 2 THEN hi_{a} ELSE (lo_{a} + hi_{a}) / 2 END AS hi_{a}"
                for a in axes
            )
            out.append(
                f"go{k} AS (SELECT file_index, point_index, x, y, z, CASE WHEN held THEN gone ELSE arrival END AS arrival, tile_id || '.' || ({digit})::VARCHAR AS id{k + 1}, {limits} FROM q{k} WHERE NOT (held AND gone IS NULL))"
            )
    stays = "\n  UNION ALL ".join(f"SELECT tile_id, {k} AS depth, point_index FROM q{k} WHERE held AND gone IS NULL" for k in range(depth + 1))
    comes = "\n  UNION ALL ".join(f"SELECT tile_id, {k} AS depth, count(*) AS n FROM q{k} GROUP BY tile_id" for k in range(depth + 1))
    return f"{digits(True, 0)},\n" + ",\n".join(out) + f",\nkept AS ({stays}),\ncame AS ({comes})"


def with_(*ctes: str, final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + f"\n{final}"
