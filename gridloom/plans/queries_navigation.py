"""Queries over navigation, room evidence and the machines that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, labels, navigation, raster
from ..streaming import machines
from .queries_evaluation import LINE
from .registry import Tables, query

H, W = 40, 64


@query("reperception", "WITH s AS (SELECT user_id, event_id, value / 500 AS credibility FROM events WHERE event_type = 'view'), a AS (SELECT *, sum(credibility) OVER w AS accumulated, count(*) OVER w AS steps FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, round(accumulated, 6) AS accumulated, steps, CASE WHEN accumulated >= 0.8 THEN 'accept_goal' WHEN steps >= 5 THEN 'reject_goal' ELSE 'continue_observing' END AS decision FROM a")
def reperception(t: Tables):
    rows = t.events.where("event_type = 'view'").selectExpr("user_id", "event_id", "value / 500 as credibility")
    return navigation.reperceived(rows, ["user_id"], "event_id", 0.8, 5).select("user_id", "event_id", "accumulated", "steps", "decision")


@query("current_room", """WITH open AS (SELECT frame, r, c FROM cells EXCEPT SELECT frame, r, c FROM occupied WHERE r % 3 = 0 EXCEPT SELECT frame, r, c FROM cells WHERE c % 16 = 0),
reached(frame, r, c) AS (SELECT o.frame, o.r, o.c FROM open o JOIN e USING (frame, r, c) WHERE event_id % 1000 = 0 UNION SELECT o.frame, o.r, o.c FROM reached q JOIN open o ON o.frame = q.frame AND abs(o.r - q.r) + abs(o.c - q.c) = 1)
SELECT * FROM reached""", recursive=True)
def current_room(t: Tables):
    start = t.e.where("event_id % 1000 = 0").select("frame", "r", "c")
    doors = t.cells.where("c % 16 = 0")
    return navigation.current_room(t.cells, t.occupied.where("r % 3 = 0"), doors, start, ["frame"], W)


@query("room_frontiers", """WITH unknown AS (SELECT f.frame, y.r, x.c FROM (SELECT DISTINCT frame FROM cells) f, range(40) y(r), range(64) x(c) EXCEPT SELECT frame, r, c FROM cells),
near AS (SELECT DISTINCT k.frame, k.r, k.c FROM cells k JOIN unknown u ON u.frame = k.frame AND abs(u.r - k.r) + abs(u.c - k.c) = 1),
link AS (SELECT a.frame, a.r * 64 + a.c AS x, b.r * 64 + b.c AS y FROM near a JOIN near b ON a.frame = b.frame AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reached(frame, x, y) AS (SELECT frame, r * 64 + c, r * 64 + c FROM near UNION SELECT q.frame, q.x, l.y FROM reached q JOIN link l ON q.frame = l.frame AND q.y = l.x),
root AS (SELECT frame, x, min(y) AS root FROM reached GROUP BY ALL), lab AS (SELECT frame, x // 64 AS r, x % 64 AS c, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS label FROM root),
mean AS (SELECT *, avg(r) OVER w AS mr, avg(c) OVER w AS mc, count(*) OVER w AS size FROM lab WINDOW w AS (PARTITION BY frame, label)),
best AS (SELECT frame, label, size, r, c FROM (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY round(pow(r - mr, 2) + pow(c - mc, 2), 9), r, c) AS k FROM mean) WHERE k = 1),
far AS (SELECT b.*, sqrt(pow(b.r - s.r, 2) + pow(b.c - s.c, 2)) AS distance FROM best b JOIN (SELECT frame, r, c FROM e WHERE event_id % 1000 = 0) s ON s.frame = b.frame)
SELECT frame, label, size, r, c, round(distance, 6) AS distance, row_number() OVER (PARTITION BY frame ORDER BY size DESC, distance, label) AS rank FROM far""", recursive=True)
def room_frontiers(t: Tables):
    start = t.e.where("event_id % 1000 = 0").select("frame", "r", "c")
    unknown = raster.complement(t.cells, t.cells, ["frame"], H, W)
    return navigation.room_frontiers(t.cells, unknown, t.occupied.limit(0), start, ["frame"], H, W)


BORDER = "side AS (SELECT DISTINCT a.scene, a.label AS a, b.label AS b, a.r, a.c FROM gt a JOIN gt b ON a.scene = b.scene AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.label < b.label)"


EVIDENCE = f"{BORDER}, wall AS (SELECT DISTINCT scene, r + i AS r, c + j AS c FROM pred, range(-1, 2) x(i), range(-1, 2) y(j) WHERE label = 3), door AS (SELECT DISTINCT scene, r, c FROM pred WHERE label = 9)"
EVIDENCE_ROWS = "SELECT s.scene, a, b, count(*) AS border, greatest(max(s.r) - min(s.r), max(s.c) - min(s.c)) + 1 AS neck, round(count(w.r) / count(*), 6) AS wall_support, count(d.r) > 0 AS doorway, CASE WHEN count(d.r) > 0 THEN 'doorway' WHEN count(w.r) / count(*) >= 0.5 THEN 'walled' WHEN greatest(max(s.r) - min(s.r), max(s.c) - min(s.c)) + 1 >= count(*) * 2 THEN 'sparse' ELSE 'open' END AS reason FROM side s LEFT JOIN wall w ON w.scene = s.scene AND w.r = s.r AND w.c = s.c LEFT JOIN door d ON d.scene = s.scene AND d.r = s.r AND d.c = s.c GROUP BY s.scene, a, b"


@query("adjacency_evidence", f"WITH {EVIDENCE} {EVIDENCE_ROWS}")
def adjacency_evidence(t: Tables):
    return navigation.adjacency_evidence(t.gt, t.pred.where("label = 3"), t.pred.where("label = 9"), ["scene"], 0)


@query("merge_open_rooms", f"WITH {EVIDENCE}, ev AS ({EVIDENCE_ROWS}), link AS (SELECT scene, a AS x, b AS y FROM ev WHERE reason = 'open' AND border >= 6 UNION ALL SELECT scene, b, a FROM ev WHERE reason = 'open' AND border >= 6), reached(scene, x, y) AS (SELECT DISTINCT scene, label, label FROM gt UNION SELECT q.scene, q.x, l.y FROM reached q JOIN link l ON q.scene = l.scene AND q.y = l.x), root AS (SELECT scene, x AS label, min(y) AS root FROM reached GROUP BY ALL) SELECT scene, r, c, root AS label FROM gt JOIN root USING (scene, label)", recursive=True)
def merge_open_rooms(t: Tables):
    evidence = navigation.adjacency_evidence(t.gt, t.pred.where("label = 3"), t.pred.where("label = 9"), ["scene"], 0)
    return navigation.merged_open_rooms(t.gt, evidence, ["scene"], 6)


@query("absorb_cells", "WITH m AS (SELECT k.frame, k.r, k.c, o.label, (k.r - o.r) * (k.r - o.r) + (k.c - o.c) * (k.c - o.c) AS d2 FROM cells k JOIN (SELECT frame, r, c, max(z) + 1 AS label FROM e WHERE occ GROUP BY ALL) o ON o.frame = k.frame AND (k.r - o.r) * (k.r - o.r) + (k.c - o.c) * (k.c - o.c) <= 9) SELECT frame, r, c, label, d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, r, c ORDER BY d2, label) AS n FROM m) WHERE n = 1")
def absorb_cells(t: Tables):
    marked = t.e.where("occ").groupBy("frame", "r", "c").agg((F.max("z") + 1).alias("label"))
    return navigation.absorbed(marked, t.cells, ["frame"], 3)


@query("structural_obstacles", "SELECT frame, r, c FROM occupied EXCEPT SELECT frame, r + dr, c + dc FROM (SELECT frame, r, c FROM e WHERE event_type = 'purchase'), (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)")
def structural_obstacles(t: Tables):
    """Purchases stand for objects, errors and purchases for what is occupied."""
    return navigation.without_clutter(t.occupied, t.e.where("event_type = 'purchase'").select("frame", "r", "c"), ["frame"], 1)


@query("range_doors", "WITH s AS (SELECT event_id // 360 AS scan, event_id % 360 AS ray, value / 100 AS d FROM events), n AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY scan ORDER BY ray), first_value(d) OVER (PARTITION BY scan ORDER BY ray)) AS nx FROM s) SELECT scan, ray, round(least(d, nx), 6) AS distance, round(abs(nx - d), 6) AS jump FROM n WHERE abs(nx - d) >= 1.2 AND least(d, nx) BETWEEN 0.2 AND 3")
def range_doors(t: Tables):
    ranges = t.events.selectExpr("event_id div 360 as scan", "event_id % 360 as ray", "value / 100 as distance")
    return navigation.range_doors(ranges, ["scan"], 1.2, 0.2, 3.0)


@query("waypoint_command", "SELECT event_id, round(least(0.5, d / 0.2) / greatest(d, 1e-9) * (dx * cos(0.3) + dy * sin(0.3)), 6) AS vx, round(greatest(-1.0, least(1.0, atan2(sin(atan2(dy, dx) - 0.3), cos(atan2(dy, dx) - 0.3)) / 0.2)), 6) AS wz FROM (SELECT event_id, dx, dy, sqrt(dx * dx + dy * dy) AS d FROM (SELECT event_id, CAST(user_id % 13 - 6 AS DOUBLE) AS dx, CAST(event_id % 7 - 2 AS DOUBLE) + 0.5 AS dy FROM events))")
def waypoint_command(t: Tables):
    move = navigation.command(F.lit(0.0), F.lit(0.0), F.lit(0.3), F.expr("cast(user_id % 13 - 6 as double)"), F.expr("cast(event_id % 7 - 2 as double) + 0.5D"), 0.5, 1.0, 0.2)
    return t.events.select("event_id", move["vx"].alias("vx"), move["wz"].alias("wz"))


@query("swept_clearance", f"WITH p AS (SELECT frame, event_id AS move_id, r AS r0, c AS c0, (r + 5) % 40 AS r1, (c + 9) % 64 AS c1 FROM e), {LINE}, near AS (SELECT DISTINCT frame, r + dr AS r, c + dc AS c FROM occupied, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)), hit AS (SELECT DISTINCT frame, move_id FROM k JOIN near USING (frame, r, c)) SELECT p.frame, p.move_id, hit.move_id IS NULL AS clear FROM p LEFT JOIN hit ON hit.frame = p.frame AND hit.move_id = p.move_id")
def swept_clearance(t: Tables):
    moves = t.e.selectExpr("frame", "event_id as move_id", "r as r0", "c as c0", "(r + 5) % 40 as r1", "(c + 9) % 64 as c1")
    return navigation.swept_clear(moves, t.occupied, ["frame"], 1)


@query("clearance_guard", "SELECT event_id, round(0.5 * greatest(0.0, least(1.0, (value / 500 - 0.2) / 0.4)), 6) AS vx FROM events")
def clearance_guard(t: Tables):
    return t.events.select("event_id", navigation.guarded(F.lit(0.5), F.lit(0.0), F.col("value") / 500, 0.2, 0.6)["vx"].alias("vx"))


@query("sample_episodes")
def sample_episodes(t: Tables):
    starts = t.supplier.selectExpr("s_nationkey % 5 as scene", "s_suppkey as start_id", "cast(s_suppkey * 37 % 101 as double) as x", "cast(s_suppkey * 53 % 97 as double) as y")
    goals = t.customer.selectExpr("c_nationkey % 5 as scene", "c_custkey as goal_id", "cast(c_custkey * 29 % 101 as double) as x", "cast(c_custkey * 31 % 97 as double) as y")
    return navigation.episodes(starts, goals, ["scene"], 7, 10, 4.0, 20.0)


@query("longest_instance", "SELECT scene, task_id, round(length, 6) AS length FROM (SELECT user_id % 20 AS scene, event_id AS task_id, value AS length, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def longest_instance(t: Tables):
    return navigation.longest_instances(t.events.selectExpr("user_id % 20 as scene", "event_id as task_id", "value as length"), ["scene"])


@query("ray_evidence_2d", """WITH p AS (SELECT event_id, frame, occ, CAST(20 AS BIGINT) AS r0, CAST(32 AS BIGINT) AS c0, r AS r1, c AS c1 FROM e),
w(event_id, frame, occ, i, r, c, err, dr, dc, sr, sc) AS (SELECT event_id, frame, occ, CAST(0 AS BIGINT), r0, c0, abs(c1 - c0) - abs(r1 - r0), abs(r1 - r0), abs(c1 - c0), CASE WHEN r0 < r1 THEN 1 ELSE -1 END, CASE WHEN c0 < c1 THEN 1 ELSE -1 END FROM p
UNION ALL SELECT event_id, frame, occ, i + 1, r + CASE WHEN 2 * err <= dc THEN sr ELSE 0 END, c + CASE WHEN 2 * err >= -dr THEN sc ELSE 0 END, err - CASE WHEN 2 * err >= -dr THEN dr ELSE 0 END + CASE WHEN 2 * err <= dc THEN dc ELSE 0 END, dr, dc, sr, sc FROM w WHERE i < greatest(dr, dc))
SELECT frame, r, c, count(*) FILTER (NOT (occ AND i = greatest(dr, dc))) AS crossed, count(*) FILTER (occ AND i = greatest(dr, dc)) AS hit FROM w WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 63 GROUP BY ALL""", recursive=True)
def ray_evidence_2d(t: Tables):
    rays = t.e.selectExpr("frame", "20 as r0", "32 as c0", "cast(r as int) as r1", "cast(c as int) as c1", "occ as is_hit")
    return navigation.ray_evidence(rays, ["frame"], H, W)


@query("nearfield", "SELECT CAST(floor(-y / 0.5) AS BIGINT) AS r, CAST(floor(x / 0.5) AS BIGINT) AS c, bool_or(z BETWEEN 0.2 AND 1.5) AS obstacle, count(*) AS seen FROM (SELECT CAST(user_id % 17 - 8 AS DOUBLE) AS x, CAST(event_id % 19 - 9 AS DOUBLE) AS y, value / 100 AS z FROM events) WHERE sqrt(x * x + y * y) <= 6 AND sqrt(x * x + y * y) > 1 GROUP BY ALL")
def nearfield(t: Tables):
    points = t.events.selectExpr("1 as one", "cast(user_id % 17 - 8 as double) as x", "cast(event_id % 19 - 9 as double) as y", "value / 100 as z")
    return navigation.nearfield(points, ["one"], 6.0, 1.0, 0.2, 1.5, 0.5).drop("one")


@query("percentile_height", "WITH h AS (SELECT user_id % 10 AS scene, step, quantile_cont(value / 100, 0.9) AS h FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY step) AS n FROM h), f(scene, n, v) AS (SELECT scene, n, h FROM o WHERE n = 1 UNION ALL SELECT f.scene, o.n, f.v + 0.2 * (o.h - f.v) FROM f JOIN o ON o.scene = f.scene AND o.n = f.n + 1) SELECT scene, round(arg_max(v, n), 6) AS height, max(n) AS frames FROM f GROUP BY 1", recursive=True)
def percentile_height(t: Tables):
    return navigation.percentile_height(t.e.selectExpr("user_id % 10 as scene", "step", "value / 100 as z"), ["scene"], ["step"], 0.9, 0.2)


@query("strict_scan", "WITH col AS (SELECT event_id // 16 AS r, event_id % 16 AS z, CASE WHEN event_id % 16 < 7 THEN 1 WHEN event_id % 16 < 9 + (event_id // 16) % 4 THEN 2 WHEN user_id % 6 = 0 THEN 1 ELSE 0 END AS state FROM e), n AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY r ORDER BY z) = state THEN 0 ELSE 1 END AS x FROM col), k AS (SELECT *, sum(x) OVER (PARTITION BY r ORDER BY z) AS run FROM n), b AS (SELECT r, run, min(state) AS s, count(*) AS n FROM k GROUP BY ALL), p AS (SELECT r, max(run) AS runs, max(CASE WHEN run = 1 AND s = 1 THEN n ELSE 0 END) AS lower_free, max(CASE WHEN run = 2 AND s = 2 THEN n ELSE 0 END) AS top_occupied, max(CASE WHEN run = 3 AND s = 0 THEN n ELSE 0 END) AS unknown_tail, max(CASE WHEN run = 3 THEN s ELSE -1 END) AS third FROM b GROUP BY r) SELECT r, lower_free, top_occupied, unknown_tail, CASE WHEN lower_free < 4 THEN 'lower_free_run_too_short' WHEN top_occupied < 2 THEN 'occupied_run_too_short' WHEN runs > 3 THEN 'states_after_tail' WHEN runs = 3 AND third <> 0 THEN 'free_above_occupied' ELSE 'accepted' END AS reason FROM p")
def strict_scan(t: Tables):
    col = t.e.selectExpr("1 as scene", "event_id div 16 as r", "0 as c", "event_id % 16 as z", "case when event_id % 16 < 7 then 1 when event_id % 16 < 9 + (event_id div 16) % 4 then 2 when user_id % 6 = 0 then 1 else 0 end as state")
    return navigation.strict_scan(col, ["scene"], 4, 2).drop("scene", "c")


@query("parallel_rejects")
def parallel_rejects(t: Tables):
    lines = t.lineitem.selectExpr("l_orderkey % 50 as frame", "'horizontal' as axis", "l_orderkey * 8 + l_linenumber as line_id", "l_suppkey % 60 as scan", "l_partkey % 100 as first", "l_partkey % 100 + 2 + l_linenumber as last")
    return navigation.without_parallel(lines, ["frame"], 2, 6, 0.2, 0.5)


@query("compound_cuts", "WITH o AS (SELECT frame, event_id AS id, r, c, value FROM e), p AS (SELECT x.frame, x.id AS a, y.id AS b, round(x.value + y.value, 6) AS score, CASE WHEN x.r = y.r AND x.c = y.c THEN 1 ELSE 2 END AS n FROM o x JOIN o y ON x.frame = y.frame AND x.id < y.id WHERE sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) <= 6) SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY a, b) AS candidate_id, a, b, score, CAST(n AS BIGINT) AS n FROM p")
def compound_cuts(t: Tables):
    one = t.e.selectExpr("frame", "event_id as candidate_id", "cast(c as double) as x", "cast(r as double) as y", "value as score", "array(named_struct('r', r, 'c', c)) as cells")
    return navigation.compound_cuts(one, ["frame"], 6.0).select("frame", "candidate_id", "a", "b", "score", F.size("cells").alias("n"))


@query("invalid_snapshots", "WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS g, count(*) FILTER (value > 300) AS d, CASE WHEN user_id % 4 > 0 THEN user_id % 4 - 1 END AS csr FROM events GROUP BY ALL) SELECT user_id, coalesce(CASE WHEN d <= 0 THEN 'empty_metric_domain' WHEN g <= 0 THEN 'empty_ground_truth' WHEN csr IS NULL THEN 'missing_csr' WHEN csr NOT IN (0, 1) THEN 'bad_csr' END, 'valid') AS reason FROM n")
def invalid_snapshots(t: Tables):
    n = t.events.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("g"), F.count(F.when(F.col("value") > 300, 1)).alias("d"))
    csr = F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4 - 1)
    return n.select("user_id", F.coalesce(labels.invalid_reason(F.col("g"), F.col("d"), csr, True), F.lit("valid")).alias("reason"))


@query("fused_instances")
def fused_instances(t: Tables):
    rows = t.e.selectExpr("user_id % 10 as scene", "step", "event_id as detection_id", "event_type as category", "array(r * 1.0D, c * 1.0D, 0.0D, r + 3.0D, c + 3.0D, 2.0D) as box")
    return machines.in_batch(rows, ["scene"], "step", machines.fused_instances, machines.OUTPUTS["fused_instances"])


@query("topology_map")
def topology_map(t: Tables):
    rows = t.e.selectExpr("user_id % 5 as scene", "step", "r", "c").groupBy("scene", "step").agg(F.min("c").alias("room_id"), F.sort_array(F.collect_set(F.struct((F.col("r") % 4).alias("r"), (F.col("c") % 12).alias("c")))).alias("cells"), F.sort_array(F.collect_set(F.col("c") % 9)).alias("doors"))
    return machines.in_batch(rows, ["scene"], "step", machines.topology_map, machines.OUTPUTS["topology_map"])


@query("execution_state", """WITH s AS (SELECT user_id % 10 AS scene, step, min(step // 7) AS target_id, min(value) / 10 AS d FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY step) AS n FROM s),
f(scene, n, step, target_id, d, best, since) AS (SELECT scene, n, step, target_id, d, d, step FROM o WHERE n = 1 UNION ALL
SELECT f.scene, o.n, o.step, o.target_id, o.d, CASE WHEN o.target_id <> f.target_id OR o.d < f.best - 0.05 THEN o.d ELSE f.best END, CASE WHEN o.target_id <> f.target_id OR o.d < f.best - 0.05 THEN o.step ELSE f.since END FROM f JOIN o ON o.scene = f.scene AND o.n = f.n + 1)
SELECT scene, step, target_id, CASE WHEN d <= 0.5 THEN 'arrived' WHEN step - since >= 10 THEN 'stalled' ELSE 'moving' END AS status, round(best, 6) AS best FROM f""", recursive=True)
def execution_state(t: Tables):
    rows = t.e.groupBy((F.col("user_id") % 10).alias("scene"), "step").agg(F.min((F.col("step") / 7).cast("long")).alias("target_id"), (F.min("value") / 10).alias("distance"))
    return machines.in_batch(rows, ["scene"], "step", machines.execution, machines.OUTPUTS["execution"])


@query("episode_results", """WITH p AS (SELECT user_id, event_id, value / 1000 AS x, (event_id % 10) / 20.0 AS y, event_type = 'error' AS collided, value / 100 AS distance FROM events),
d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, count(*) AS steps, count(*) FILTER (collided) AS collisions, sum(CASE WHEN d < 0.5 THEN d ELSE 0 END) AS path_length, arg_max(distance, event_id) AS left_m, CAST(user_id % 7 AS DOUBLE) + 0.5 AS shortest FROM d GROUP BY user_id),
o AS (SELECT *, user_id % 3 <> 0 AND left_m <= 1.0 AND user_id % 11 <> 0 AS success FROM s)
SELECT user_id, steps, collisions, round(path_length, 6) AS path_length, round(left_m, 6) AS distance_to_goal, success, round(CASE WHEN success THEN shortest / greatest(path_length, shortest, 1e-6) ELSE 0 END, 6) AS spl, round(greatest(0.0, 1 - left_m / shortest) * shortest / greatest(path_length, shortest, 1e-6), 6) AS softspl FROM o""")
def episode_results(t: Tables):
    steps = t.events.selectExpr("user_id", "event_id", "value / 1000 as x", "(event_id % 10) / 20.0D as y", "event_type = 'error' as collided", "value / 100 as distance")
    runs = t.events.select("user_id").distinct().selectExpr("user_id", "user_id % 7 + 0.5D as shortest", "1.0D as success_distance", "user_id % 3 <> 0 as stop_called", "if(user_id % 11 = 0, 'stuck', null) as failure_reason")
    return navigation.evaluated(steps, runs, ["user_id"], "event_id").select("user_id", "steps", "collisions", "path_length", "distance_to_goal", "success", "spl", "softspl")


@query("merged_goals")
def merged_goals(t: Tables):
    nodes = t.e.selectExpr("frame", "event_type as category", "event_id as node_id", "cast(c as double) as x", "cast(r as double) as y", "user_id % 4 + 1 as observed")
    return navigation.merged_goals(nodes, ["frame", "category"], 4.0)


@query("topology_rooms")
def topology_rooms(t: Tables):
    masks = t.e.where("occ").selectExpr("frame", "user_id % 6 + 1 as node_id", "r", "c")
    return grids.rooms_of_nodes(masks, t.cells, ["frame"], H, W)
