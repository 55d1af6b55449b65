"""Queries over rasters and runs, on cells derived from events and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, scalar
from ..operators import doors, frontier, grids, matching, raster, runs
from .registry import Tables, query

H, W = 40, 64
DISK2 = ", ".join(f"({r}, {c})" for r, c in raster.disk(2))
CROSS = ", ".join(f"({r}, {c})" for r, c in raster.CROSS)
FRAME = coords.MapFrame(0.05, -20.0, 20.0, 800, 800, -0.1, 0.05, 82)


@query("grid_project", "SELECT event_id, CAST(floor((20.0 - user_id / 7.0) / 0.05) AS BIGINT) AS row, CAST(floor((value / 10 - -20.0) / 0.05) AS BIGINT) AS col, floor((20.0 - user_id / 7.0) / 0.05) BETWEEN 0 AND 799 AND floor((value / 10 - -20.0) / 0.05) BETWEEN 0 AND 799 AS inside, CASE WHEN floor((value / 100 - -0.1) / 0.05) BETWEEN 0 AND 81 THEN CAST(floor((value / 100 - -0.1) / 0.05) AS BIGINT) ELSE -1 END AS z_bin FROM events")
def grid_project(t: Tables):
    row, col = coords.row_of(F.col("user_id") / 7.0, FRAME), coords.col_of(F.col("value") / 10, FRAME)
    return t.events.select("event_id", row.alias("row"), col.alias("col"), coords.inside(row, col, FRAME).alias("inside"), F.coalesce(coords.z_bin(F.col("value") / 100, FRAME), F.lit(-1)).alias("z_bin"))


@query("camera_points", "SELECT event_id, round((user_id - 319.5) * (value / 100) / 301.7, 6) AS cam_x, round(value / 100 / sqrt(1 + pow((user_id - 319.5) / 301.7, 2) + pow((event_id % 480 - 239.5) / 301.7, 2)), 6) AS plane_z, round(1.5 + (value / 100) * cos(0.5) + ((user_id - 319.5) * (value / 100) / 301.7) * sin(0.5), 6) AS world_x FROM events")
def camera_points(t: Tables):
    camera = coords.Camera(301.7, 301.7, 319.5, 239.5)
    u, v, d = F.col("user_id"), F.col("event_id") % 480, F.col("value") / 100
    p = coords.backprojected(u, v, d, camera)
    world = coords.to_world(p["cam_x"], p["cam_y"], p["cam_z"], F.lit(1.5), F.lit(0.0), F.lit(0.0), F.lit(0.5))
    return t.events.select("event_id", p["cam_x"].alias("cam_x"), coords.plane_depth(d, u, v, camera).alias("plane_z"), world["x"].alias("world_x"))


@query("hit_classify", "SELECT CASE WHEN value / 50 > 0.2 AND value / 50 < 5.0 - 0.001 THEN 'hit' WHEN value / 50 >= 5.0 - 0.001 THEN 'free_only' ELSE 'bad' END AS class, count(*) AS n FROM events GROUP BY 1")
def hit_classify(t: Tables):
    return t.events.groupBy(coords.hit_class(F.col("value") / 50, 0.2, 5.0).alias("class")).agg(F.count("*").alias("n"))


@query("dilate_disk", f"SELECT DISTINCT frame, r + dr AS r, c + dc AS c FROM occupied, (VALUES {DISK2}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 39 AND c + dc BETWEEN 0 AND 63")
def dilate_disk(t: Tables):
    return raster.dilate(t.occupied, ["frame"], raster.disk(2), H, W)


@query("erode_cross", f"SELECT a.frame, a.r, a.c FROM cells a, (VALUES {CROSS}) o(dr, dc), cells b WHERE b.frame = a.frame AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL HAVING count(*) = 5")
def erode_cross(t: Tables):
    return raster.erode(t.cells, ["frame"], raster.CROSS, H, W)


@query("close_disk", f"WITH d AS (SELECT DISTINCT frame, r + dr AS r, c + dc AS c FROM occupied, (VALUES {DISK2}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 39 AND c + dc BETWEEN 0 AND 63) SELECT a.frame, a.r, a.c FROM d a, (VALUES {DISK2}) o(dr, dc), d b WHERE b.frame = a.frame AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL HAVING count(*) = 13")
def close_disk(t: Tables):
    return raster.close(t.occupied, ["frame"], raster.disk(2), H, W)


@query("inner_boundary", f"WITH k AS (SELECT a.frame, a.r, a.c FROM cells a, (VALUES {CROSS}) o(dr, dc), cells b WHERE b.frame = a.frame AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL HAVING count(*) = 5) SELECT frame, r, c FROM cells EXCEPT SELECT frame, r, c FROM k")
def inner_boundary(t: Tables):
    return raster.inner_boundary(t.cells, ["frame"], H, W)


@query("set_diff_domain", "SELECT frame, r, c FROM cells EXCEPT SELECT frame, r, c FROM occupied")
def set_diff_domain(t: Tables):
    return raster.minus(t.cells, t.occupied, ["frame"])


def _components(reach: str) -> str:
    return f"""WITH link AS (SELECT a.frame, a.r * 64 + a.c AS x, b.r * 64 + b.c AS y FROM cells a JOIN cells b ON a.frame = b.frame AND {reach}),
reached(frame, x, y) AS (SELECT frame, r * 64 + c, r * 64 + c FROM cells UNION SELECT q.frame, q.x, l.y FROM reached q JOIN link l ON q.frame = l.frame AND q.y = l.x),
root AS (SELECT frame, x, min(y) AS root FROM reached GROUP BY ALL)
SELECT frame, x // 64 AS r, x % 64 AS c, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS label FROM root"""


@query("components4", _components("abs(a.r - b.r) + abs(a.c - b.c) = 1"), recursive=True)
def components4(t: Tables):
    return raster.components(t.cells, ["frame"], W, 4)


@query("components8", _components("greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1"), recursive=True)
def components8(t: Tables):
    return raster.components(t.cells, ["frame"], W, 8)


@query("component_filter", _components("abs(a.r - b.r) + abs(a.c - b.c) = 1").replace("SELECT frame, x // 64 AS r", "SELECT frame, r, c FROM (SELECT frame, x // 64 AS r").replace("AS label FROM root", "AS label, count(*) OVER (PARTITION BY frame, root) AS n FROM root) WHERE n >= 4"), recursive=True)
def component_filter(t: Tables):
    return raster.without_small(t.cells, ["frame"], W, 4, 4)


@query("fill_holes", """WITH u AS (SELECT f.frame, y.r, x.c FROM (SELECT DISTINCT frame FROM cells) f, range(40) y(r), range(64) x(c) EXCEPT SELECT frame, r, c FROM cells),
walk(frame, r0, c0, r, c, d) AS (SELECT frame, r, c, r, c, 0 FROM u UNION SELECT w.frame, w.r0, w.c0, u.r, u.c, w.d + 1 FROM walk w JOIN u ON u.frame = w.frame AND abs(u.r - w.r) + abs(u.c - w.c) = 1 WHERE w.d < 4),
hole AS (SELECT frame, r0 AS r, c0 AS c FROM walk GROUP BY ALL HAVING count(DISTINCT walk.r * 64 + walk.c) <= 4 AND min(walk.r) > 0 AND min(walk.c) > 0 AND max(walk.r) < 39 AND max(walk.c) < 63)
SELECT frame, r, c FROM cells UNION SELECT frame, r, c FROM hole""", recursive=True)
def fill_holes(t: Tables):
    return raster.filled_holes(t.cells, t.cells.select("frame").distinct(), ["frame"], H, W, 4)


@query("flood_from_seeds", _components("abs(a.r - b.r) + abs(a.c - b.c) = 1").replace("SELECT frame, x // 64 AS r, x % 64 AS c, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS label FROM root", "SELECT frame, x // 64 AS r, x % 64 AS c FROM root WHERE (frame, root) IN (SELECT q.frame, q.root FROM root q JOIN e ON e.frame = q.frame AND e.r * 64 + e.c = q.x WHERE event_id % 1000 = 0)"), recursive=True)
def flood_from_seeds(t: Tables):
    return raster.flooded(t.cells, t.e.where("event_id % 1000 = 0").select("frame", "r", "c"), ["frame"], W)


@query("snap_to_cell", "WITH s AS (SELECT DISTINCT frame, r AS seed_r, (c + 3) % 64 AS seed_c FROM e WHERE event_id % 50 = 0), m AS (SELECT s.*, o.r, o.c, (o.r - seed_r) * (o.r - seed_r) + (o.c - seed_c) * (o.c - seed_c) AS d2 FROM s JOIN occupied o ON o.frame = s.frame AND (o.r - seed_r) * (o.r - seed_r) + (o.c - seed_c) * (o.c - seed_c) <= 25) SELECT frame, seed_r, seed_c, r, c, d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, seed_r, seed_c ORDER BY d2, r, c) AS n FROM m) WHERE n = 1")
def snap_to_cell(t: Tables):
    return raster.snapped(t.occupied, t.e.where("event_id % 50 = 0").selectExpr("frame", "r", "(c + 3) % 64 as c").distinct(), ["frame"], 5)


@query("edt_sq", "SELECT a.frame, a.r, a.c, min(CASE WHEN (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 64 THEN (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) END) AS d2 FROM cells a LEFT JOIN occupied b ON a.frame = b.frame GROUP BY a.frame, a.r, a.c")
def edt_sq(t: Tables):
    return raster.squared_distance(t.cells, t.occupied, ["frame"], 8)


@query("frontier_cells", "WITH far AS (SELECT frame, r, c FROM cells EXCEPT SELECT o.frame, o.r + d.dr, o.c + e2.dc FROM occupied o, range(-1, 2) d(dr), range(-1, 2) e2(dc) WHERE dr * dr + dc * dc <= 1), unknown AS (SELECT f.frame, y.r, x.c FROM (SELECT DISTINCT frame FROM cells) f, range(40) y(r), range(64) x(c) EXCEPT SELECT frame, r, c FROM cells) SELECT DISTINCT far.frame, far.r, far.c FROM far JOIN unknown u ON u.frame = far.frame AND abs(u.r - far.r) + abs(u.c - far.c) <= 1")
def frontier_cells(t: Tables):
    unknown = raster.complement(t.cells, t.cells, ["frame"], H, W)
    return frontier.frontier_cells(t.cells, t.occupied, unknown, ["frame"], H, W, 1, 1)


@query("frontier_clusters")
def frontier_clusters(t: Tables):
    found = frontier.clusters(t.cells, ["frame"], W, 5)
    field = grids.distance_field(t.cells, t.e.where("event_id % 1000 = 0").select("frame", "r", "c"), ["frame"], H, W)
    ranked = frontier.ranked(frontier.with_distance(found, field, ["frame"], "min"), ["frame"], 1.0, 5)
    return ranked.select("frame", "label", "size", "r", "c", "distance", "rank")


@query("line_rasterise", "WITH p AS (SELECT event_id, r AS r0, c AS c0, (r * 7 + 3) % 40 AS r1, (c * 5 + 11) % 64 AS c1 FROM e), n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM p) SELECT event_id, i, CAST(round_even(r0 + (r1 - r0) * i / CAST(greatest(n, 1) AS DOUBLE), 0) AS BIGINT) AS r, CAST(round_even(c0 + (c1 - c0) * i / CAST(greatest(n, 1) AS DOUBLE), 0) AS BIGINT) AS c FROM (SELECT *, unnest(range(n + 1)) AS i FROM n)")
def line_rasterise(t: Tables):
    rows = t.e.selectExpr("event_id", "r as r0", "c as c0", "(r * 7 + 3) % 40 as r1", "(c * 5 + 11) % 64 as c1")
    cells = raster.line_cells(*[F.col(x) for x in ("r0", "c0", "r1", "c1")])
    return rows.select("event_id", F.posexplode(cells).alias("i", "p")).select("event_id", "i", "p.r", "p.c")


@query("bresenham", """WITH p AS (SELECT event_id, r AS r0, c AS c0, (r * 7 + 3) % 40 AS r1, (c * 5 + 11) % 64 AS c1 FROM e),
w(event_id, i, r, c, err, r1, c1, dr, dc, sr, sc) AS (SELECT event_id, CAST(0 AS BIGINT), r0, c0, abs(c1 - c0) - abs(r1 - r0), r1, c1, abs(r1 - r0), abs(c1 - c0), CASE WHEN r0 < r1 THEN 1 ELSE -1 END, CASE WHEN c0 < c1 THEN 1 ELSE -1 END FROM p
UNION ALL SELECT event_id, i + 1, r + CASE WHEN 2 * err <= dc THEN sr ELSE 0 END, c + CASE WHEN 2 * err >= -dr THEN sc ELSE 0 END, err - CASE WHEN 2 * err >= -dr THEN dr ELSE 0 END + CASE WHEN 2 * err <= dc THEN dc ELSE 0 END, r1, c1, dr, dc, sr, sc FROM w WHERE i < greatest(dr, dc))
SELECT event_id, i, r, c FROM w""", recursive=True)
def bresenham(t: Tables):
    rows = t.e.selectExpr("event_id", "r as r0", "c as c0", "(r * 7 + 3) % 40 as r1", "(c * 5 + 11) % 64 as c1")
    return rows.select("event_id", F.posexplode(raster.bresenham_cells(*[F.col(x) for x in ("r0", "c0", "r1", "c1")])).alias("i", "p")).select("event_id", "i", "p.r", "p.c")


RUNS = "i AS (SELECT *, c - row_number() OVER (PARTITION BY frame, r ORDER BY c) AS k FROM lines), rr AS (SELECT frame, r, min(c) AS first, max(c) AS last FROM i GROUP BY frame, r, k)"


@query("row_runs", f"WITH {RUNS} SELECT * FROM rr")
def row_runs(t: Tables):
    return raster.row_runs(t.lines, ["frame"])


@query("long_runs", f"WITH {RUNS}, j AS (SELECT *, r - row_number() OVER (PARTITION BY frame, c ORDER BY r) AS k FROM lines), cr AS (SELECT frame, c, min(r) AS first, max(r) AS last FROM j GROUP BY frame, c, k) SELECT frame, r, unnest(range(first, last + 1)) AS c FROM rr WHERE last - first + 1 >= 3 UNION SELECT frame, unnest(range(first, last + 1)) AS r, c FROM cr WHERE last - first + 1 >= 3")
def long_runs(t: Tables):
    return runs.long_run_cells(t.lines, ["frame"], 3)


@query("gap_fill", f"WITH {RUNS}, g AS (SELECT frame, r, lag(last) OVER (PARTITION BY frame, r ORDER BY first) + 1 AS a, first - 1 AS b FROM rr) SELECT frame, r, c FROM lines UNION SELECT frame, r, unnest(range(a, b + 1)) AS c FROM g WHERE b - a + 1 <= 2")
def gap_fill(t: Tables):
    return runs.filled_gaps(t.lines, ["frame"], 2)


@query("line_sessions", "WITH s AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY frame, r ORDER BY c) > 5 THEN 1 ELSE 0 END AS x FROM lines) SELECT frame, r, c, CAST(sum(x) OVER (PARTITION BY frame, r ORDER BY c) AS BIGINT) AS session FROM s")
def line_sessions(t: Tables):
    return runs.sessions(t.lines, ["frame", "r"], "c", 5)


@query("line_statistics", "WITH s AS (SELECT *, c - lag(c) OVER (PARTITION BY frame, r ORDER BY c) AS g FROM lines) SELECT frame, r, count(*) AS n, min(c) AS first, max(c) AS last, coalesce(max(g), 0) AS max_gap, round(count(*) / (max(c) - min(c) + 1), 6) AS contiguity FROM s GROUP BY frame, r")
def line_statistics(t: Tables):
    return runs.along_statistics(t.lines, ["frame", "r"], "c")


@query("width_jumps", f"WITH {RUNS}, p AS (SELECT a.frame, a.r, a.first AS f1, a.last AS l1, b.first AS f0, b.last AS l0 FROM rr a JOIN rr b ON a.frame = b.frame AND b.r = a.r - 1 AND a.first <= b.last AND b.first <= a.last WHERE abs((a.last - a.first) - (b.last - b.first)) >= 2), k AS (SELECT frame, CASE WHEN l1 - f1 <= l0 - f0 THEN r ELSE r - 1 END AS line, CASE WHEN l1 - f1 <= l0 - f0 THEN f1 ELSE f0 END AS a, CASE WHEN l1 - f1 <= l0 - f0 THEN l1 ELSE l0 END AS b, abs((l1 - f1) - (l0 - f0)) AS d FROM p) SELECT frame, 'horizontal' AS axis, line, a AS first, b AS last, max(d) AS drop FROM k WHERE b > a GROUP BY frame, line, a, b")
def width_jumps(t: Tables):
    return runs.width_jumps(t.lines, ["frame"], 0.05, 0.1)


def _wall_runs(t: Tables):
    return t.lineitem.selectExpr("l_orderkey % 50 as frame", "l_orderkey * 8 + l_linenumber as run_id", "'horizontal' as axis", "l_suppkey % 30 as line", "l_partkey % 150 as first", "l_partkey % 150 + l_linenumber as last", "1.0D as confidence")


@query("run_gaps", "WITH w AS (SELECT l_orderkey % 50 AS frame, l_orderkey * 8 + l_linenumber AS run_id, l_suppkey % 30 AS line, l_partkey % 150 AS first, l_partkey % 150 + l_linenumber AS last FROM lineitem) SELECT DISTINCT a.frame, 'horizontal' AS axis, a.run_id AS a, b.run_id AS b, (a.line + b.line) // 2 AS line, a.last + 1 AS \"from\", b.first - 1 AS \"to\", b.first - a.last - 1 AS gap FROM w a JOIN w b ON a.frame = b.frame AND a.run_id <> b.run_id AND abs(a.line - b.line) <= 1 AND b.first - a.last - 1 > 0 AND b.first - a.last - 1 < 3")
def run_gaps(t: Tables):
    return runs.run_gaps(_wall_runs(t), ["frame"], 1, 3)


@query("merge_runs_first_fit")
def merge_runs_first_fit(t: Tables):
    return runs.merged_first_fit(_wall_runs(t), ["frame"], 1, 2, 1)


@query("moving_drop", "WITH p AS (SELECT frame, c, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT *, avg(n) OVER (PARTITION BY frame ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM p) SELECT frame, c, n, round(smooth, 6) AS smooth, round(least(max(smooth) OVER (PARTITION BY frame ORDER BY c ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), max(smooth) OVER (PARTITION BY frame ORDER BY c ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - smooth, 6) AS drop FROM s")
def moving_drop(t: Tables):
    return runs.moving_drop(t.cells.groupBy("frame", "c").agg(F.count("*").alias("n")), ["frame"], "c", "n", 1, 5)


@query("axis_votes", "SELECT frame, r + d AS line, c AS along, CAST(count(*) * 2 AS BIGINT) AS votes FROM occupied, range(-1, 2) t(d) GROUP BY ALL")
def axis_votes(t: Tables):
    return runs.axis_votes(t.occupied.withColumn("w", F.lit(2)), ["frame"], "w", 1)


@query("wall_segments", """WITH near AS (SELECT frame, r + d AS line, c AS along, r AS own FROM lines, range(-1, 2) t(d)), p AS (SELECT DISTINCT frame, line, along FROM near), i AS (SELECT *, along - row_number() OVER (PARTITION BY frame, line ORDER BY along) AS k FROM p),
span AS (SELECT frame, line, min(along) AS first, max(along) AS last FROM i GROUP BY frame, line, k HAVING count(*) >= 4),
held AS (SELECT s.frame, s.line, first, last, floor(quantile_cont(own, 0.5)) AS middle, count(*) FILTER (own = s.line) / (last - first + 1) AS support FROM near n JOIN span s ON s.frame = n.frame AND s.line = n.line AND n.along BETWEEN first AND last GROUP BY s.frame, s.line, first, last)
SELECT frame, 'horizontal' AS axis, line, first, last, round(support, 6) AS support FROM held WHERE middle = line AND support >= 0.3""")
def wall_segments(t: Tables):
    return runs.wall_segments(t.lines, ["frame"], 1, 4, 0.3)


@query("first_hits", "WITH m AS (SELECT frame, event_id AS march_id, r, c FROM e), s AS (SELECT m.frame, march_id, i AS step, m.r, m.c + i AS c FROM m, range(1, 21) t(i)), h AS (SELECT s.*, row_number() OVER (PARTITION BY s.frame, march_id ORDER BY step) AS n FROM s JOIN occupied o ON o.frame = s.frame AND o.r = s.r AND o.c = s.c) SELECT m.frame, m.march_id, CASE WHEN h.step IS NULL THEN 'none' ELSE 'hit' END AS reason, coalesce(h.step, -1) AS steps, coalesce(h.r, -1) AS r, coalesce(h.c, -1) AS c FROM m LEFT JOIN h ON h.frame = m.frame AND h.march_id = m.march_id AND h.n = 1")
def first_hits(t: Tables):
    marches = t.e.selectExpr("frame", "event_id as march_id", "r", "c", "0 as dr", "1 as dc")
    return runs.first_hits(marches, ["frame"], t.occupied, t.occupied.limit(0), 20).fillna(-1, ["steps", "r", "c"])


@query("component_geometry", _components("greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1").replace("SELECT frame, x // 64 AS r", ", lab AS (SELECT frame, x // 64 AS r").replace("AS label FROM root", "AS label FROM root) SELECT frame, label, count(*) AS area, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, round(avg(r), 6) AS centre_r, round(avg(c), 6) AS centre_c, round(sqrt(greatest((var_pop(r) + var_pop(c)) / 2 + sqrt(pow((var_pop(r) - var_pop(c)) / 2, 2) + pow(covar_pop(r, c), 2)), 0)), 6) AS along FROM lab GROUP BY ALL"), recursive=True)
def component_geometry(t: Tables):
    return doors.geometry(raster.components(t.cells, ["frame"], W, 8), ["frame"]).drop("dir_r", "dir_c", "across")


@query("partition_layers", "SELECT event_id, (p AND NOT f) AS wall_anchor, (p AND NOT f AND NOT d) AS partition_wall, f AND NOT (p AND NOT f AND NOT d) AS partition_free, NOT (p AND NOT f AND NOT d) AND NOT (f AND NOT (p AND NOT f AND NOT d)) AS partition_unknown FROM (SELECT event_id, occ OR r % 5 = 0 AS p, c % 3 = 0 AS f, z = 2 AS d FROM e)")
def partition_layers(t: Tables):
    rows = t.e.selectExpr("event_id", "occ as strict_wall", "r % 5 = 0 as projected_wall", "false as completed_wall", "c % 3 = 0 as vertical_free", "z = 2 as accepted_door")
    return doors.partition_layers(rows).select("event_id", "wall_anchor", "partition_wall", "partition_free", "partition_unknown")


@query("side_ratios", "WITH l AS (SELECT DISTINCT frame, r % 4 AS line_id, r, c FROM e WHERE z = 1), s AS (SELECT l.frame, line_id, CASE WHEN d < 0 THEN 'low' ELSE 'high' END AS side, l.r + d AS r, l.c FROM l, (VALUES (-1), (1)) o(d)) SELECT s.frame, line_id, side, round(count(k.r) / count(*), 6) AS free_ratio, round(count(o.r) / count(*), 6) AS unknown_ratio FROM s LEFT JOIN cells k ON k.frame = s.frame AND k.r = s.r AND k.c = s.c LEFT JOIN occupied o ON o.frame = s.frame AND o.r = s.r AND o.c = s.c GROUP BY ALL")
def side_ratios(t: Tables):
    lines = t.e.where("z = 1").selectExpr("frame", "r % 4 as line_id", "'horizontal' as axis", "r", "c").distinct()
    return doors.side_ratios(lines, ["frame"], t.cells, t.occupied, 1)


@query("partition_cut", """WITH l AS (SELECT k.frame, k.r AS candidate_id, k.c AS pos, k.r, k.c, o.r IS NOT NULL AS wall FROM cells k LEFT JOIN occupied o USING (frame, r, c)),
m AS (SELECT *, min(pos) FILTER (wall) OVER p AS a, max(pos) FILTER (wall) OVER p AS b FROM l WINDOW p AS (PARTITION BY frame, candidate_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY frame, candidate_id) AS n FROM m WHERE pos > a AND pos < b AND NOT wall)
SELECT frame, candidate_id, pos, r, c FROM k WHERE n >= 2""")
def partition_cut(t: Tables):
    line = t.cells.selectExpr("frame", "r as candidate_id", "c as pos", "r", "c")
    return doors.partition_cut(line, ["frame"], t.occupied, t.cells, 2, 2)


@query("axis_snap", "SELECT event_id, CASE WHEN dc >= dr THEN 'horizontal' ELSE 'vertical' END AS axis, CAST(round_even(CASE WHEN dc >= dr THEN (r0 + r1) / 2 ELSE (c0 + c1) / 2 END, 0) AS BIGINT) AS line, CASE WHEN dc >= dr THEN least(c0, c1) ELSE least(r0, r1) END AS first FROM (SELECT *, abs(r1 - r0) AS dr, abs(c1 - c0) AS dc FROM (SELECT event_id, r AS r0, c AS c0, (r * 3 + z) % 40 AS r1, (c * 3 + 1) % 64 AS c1 FROM e)) WHERE degrees(atan2(CAST(least(dr, dc) AS DOUBLE), CAST(greatest(dr, dc) AS DOUBLE))) <= 25")
def axis_snap(t: Tables):
    rows = t.e.selectExpr("event_id", "r as r0", "c as c0", "(r * 3 + z) % 40 as r1", "(c * 3 + 1) % 64 as c1")
    return doors.snapped_to_axis(rows).select("event_id", "axis", "line", "first")


@query("door_clusters")
def door_clusters(t: Tables):
    shapes = doors.geometry(raster.components(t.occupied, ["frame"], W, 8), ["frame"])
    return doors.clusters(shapes, ["frame"], 2, 1.5)


@query("distance_relax", """WITH s AS (SELECT frame, r, c FROM e WHERE event_id % 1000 = 0),
walk(frame, r, c, d) AS (SELECT frame, r, c, 0 FROM s UNION SELECT k.frame, k.r, k.c, w.d + 1 FROM walk w JOIN cells k ON k.frame = w.frame AND abs(k.r - w.r) + abs(k.c - w.c) = 1 WHERE w.d < 60)
SELECT frame, r, c, CAST(min(d) AS DOUBLE) AS distance FROM walk GROUP BY frame, r, c""", recursive=True)
def distance_relax(t: Tables):
    """From the first event's cell of every frame."""
    return grids.distance_field(t.cells, t.e.where("event_id % 1000 = 0").select("frame", "r", "c"), ["frame"], H, W, diagonal=False)


@query("shortest_paths")
def shortest_paths(t: Tables):
    tasks = t.cells.groupBy("frame").agg(F.min(F.struct("r", "c")).alias("start"), F.collect_list(F.when(F.col("c") > 60, F.struct("r", "c"))).alias("goals")).withColumn("task_id", F.lit(1).cast("long"))
    return grids.paths(t.cells, tasks, ["frame"], H, W).select("frame", "task_id", "length", F.size("cells").alias("n"))


def _rooms(t: Tables):
    return raster.dilate(t.cells, ["frame"], raster.disk(1), H, W)


for _method, _parameters in {"components": {"least": 3}, "watershed": {}, "erosion": {"least_cells": 6, "least_part": 12}, "morphological": {"low": 2, "high": 60}, "distance": {"low": 2, "high": 200}, "voronoi": {"resolution": 1.0, "merge_below": 30.0, "force_below": 6.0, "low": 2.0, "stride": 6}}.items():
    query(f"segment_{_method}")(lambda t, m=_method, p=_parameters: grids.segmented(_rooms(t), ["frame"], H, W, m, **p))


@query("cuts_accepted")
def cuts_accepted(t: Tables):
    cuts = raster.row_runs(_rooms(t), ["frame"], "c", "r").where("last - first < 8").selectExpr("frame", "cast(c * 1000 + first as long) as candidate_id", "cast(first - last as double) as score", "transform(sequence(first, last), x -> named_struct('r', x, 'c', c)) as cells")
    return grids.cuts_accepted(_rooms(t), cuts, ["frame"], H, W, 2)


@query("cuts_closed")
def cuts_closed(t: Tables):
    cuts = raster.row_runs(_rooms(t), ["frame"], "c", "r").where("last - first < 8").selectExpr("frame", "cast(c * 1000 + first as long) as candidate_id", "transform(sequence(first, last), x -> named_struct('r', x, 'c', c)) as cells")
    return grids.cuts_closed(_rooms(t), cuts, ["frame"], H, W)


@query("seed_lines")
def seed_lines(t: Tables):
    return grids.seed_lines(t.occupied.withColumn("g", F.col("r") % 6), ["frame"], "g")


@query("truth_from_annotation")
def truth_from_annotation(t: Tables):
    lines = t.cells.select("frame").distinct().selectExpr("frame", "0 as r0", "20 as c0", "39 as r1", "20 as c1", "2 as width")
    return grids.truth_from_annotation(_rooms(t), lines, ["frame"], H, W, 4)


@query("polygon_cells", "WITH p AS (SELECT s_suppkey AS id, s_suppkey % 20 AS x, s_suppkey % 15 AS y, 3 + s_suppkey % 4 AS d FROM supplier) SELECT id AS polygon_id, r, c FROM (SELECT p.*, unnest(range(y, y + d + 1)) AS r FROM p), range(0, 30) t(c) WHERE c BETWEEN x AND x + d AND (c + 0.5 - x) + (r + 0.5 - y) < d")
def polygon_cells(t: Tables):
    p = t.supplier.selectExpr("s_suppkey as polygon_id", "1 as frame", "cast(s_suppkey % 20 as double) as x", "cast(s_suppkey % 15 as double) as y", "cast(3 + s_suppkey % 4 as double) as d")
    points = p.selectExpr("frame", "polygon_id", "array(named_struct('x', x, 'y', -y), named_struct('x', x + d, 'y', -y), named_struct('x', x, 'y', -y - d)) as points")
    return matching.polygon_cells(points, ["frame"], 1.0, 0.0, 0.0).drop("frame")


@query("box_cells", "WITH b AS (SELECT r, c FROM e WHERE z < 4 AND event_type = 'error'), o AS (SELECT r, c FROM e WHERE event_type = 'purchase'), s AS (SELECT DISTINCT r + i AS r, c + j AS c FROM b, range(3) t(i), range(2) u(j) WHERE r + i < 40 AND c + j < 64) SELECT r, c FROM s EXCEPT SELECT r, c FROM o")
def box_cells(t: Tables):
    box = lambda where, h, w: t.e.where(where).selectExpr("1 as frame", "r as r0", f"r + {h} as r1", "c as c0", f"c + {w} as c1", "cast(z as double) as z0", "z + 1.0D as z1")
    return matching.box_cells(box("event_type = 'error'", 2, 1), ["frame"], 0.0, 4.0, H, W, box("event_type = 'purchase'", 0, 0)).drop("frame")


@query("slug", "SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g') AS slug FROM pages")
def slug(t: Tables):
    return t.pages.select("page_id", scalar.slug(F.col("url")).alias("slug"))


@query("json_prop", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(t: Tables):
    return t.events.select("event_id", scalar.json_int(F.col("props"), "k").alias("k"))


@query("step_of_path", "SELECT event_id, event_id AS step, CASE WHEN event_id % 2 = 0 THEN 'filename' ELSE 'metadata' END AS source FROM events")
def step_of_path(t: Tables):
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/runs/a/snapshot_step_"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".npz"))).otherwise("/runs/a/last.npz")
    return t.events.select("event_id", scalar.step_with_source(path, F.lit(None).cast("long"), F.col("event_id")).alias("s")).select("event_id", "s.step", "s.source")


@query("normal_category", "SELECT DISTINCT p_name, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[_\\-\\s]+', ' ', 'g'), '\\s+[0-9]+$', '')) AS category FROM part")
def normal_category(t: Tables):
    return t.part.select("p_name", scalar.normal_category(F.col("p_name")).alias("category")).distinct()
