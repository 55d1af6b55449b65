"""Queries over rays and voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, scalar
from ..operators import voxels
from .registry import Tables, query

RAY = "event_id, (user_id % 8) + 0.37 AS z0, (event_id % 40) + 0.41 AS r0, (event_id * 7 % 64) + 0.29 AS c0, (event_id % 8) + 0.61 AS z1, (event_id * 3 % 40) + 0.83 AS r1, (event_id * 11 % 64) + 0.53 AS c1"


def _rays(t: Tables):
    d = lambda x: f"cast({x} as double)"
    return t.e.selectExpr("event_id", "step", "occ as is_hit", f"{d('user_id % 8')} + 0.37D as oz", f"{d('event_id % 40')} + 0.41D as or_", f"{d('event_id * 7 % 64')} + 0.29D as oc", f"{d('event_id % 8')} + 0.61D as ez", f"{d('event_id * 3 % 40')} + 0.83D as er", f"{d('event_id * 11 % 64')} + 0.53D as ec")


DDA = """WITH p AS (SELECT event_id, CAST(user_id % 8 AS DOUBLE) + 0.37 AS z0, CAST(event_id % 40 AS DOUBLE) + 0.41 AS r0, CAST(event_id * 7 % 64 AS DOUBLE) + 0.29 AS c0, CAST(event_id % 8 AS DOUBLE) + 0.61 AS z1, CAST(event_id * 3 % 40 AS DOUBLE) + 0.83 AS r1, CAST(event_id * 11 % 64 AS DOUBLE) + 0.53 AS c1 FROM e),
x AS (SELECT event_id, (k - z0) / (z1 - z0) AS t FROM p, range(0, 9) g(k) WHERE k > least(z0, z1) AND k <= greatest(z0, z1)
UNION ALL SELECT event_id, (k - r0) / (r1 - r0) FROM p, range(0, 41) g(k) WHERE k > least(r0, r1) AND k <= greatest(r0, r1)
UNION ALL SELECT event_id, (k - c0) / (c1 - c0) FROM p, range(0, 65) g(k) WHERE k > least(c0, c1) AND k <= greatest(c0, c1)),
y AS (SELECT *, lag(t) OVER (PARTITION BY event_id ORDER BY t) AS before FROM x),
b AS (SELECT event_id, t FROM y WHERE t - coalesce(before, 0) > 0.000001 AND t < 1 - 0.000001 UNION ALL SELECT event_id, 0.0 FROM p UNION ALL SELECT event_id, 1.0 FROM p),
m AS (SELECT event_id, row_number() OVER w - 1 AS pos, (t + lead(t) OVER w) / 2 AS m FROM b WINDOW w AS (PARTITION BY event_id ORDER BY t))
"""


@query("dda_cells", DDA + """SELECT event_id, pos, CAST(floor(z0 + (z1 - z0) * m) AS BIGINT) AS z, CAST(floor(r0 + (r1 - r0) * m) AS BIGINT) AS r, CAST(floor(c0 + (c1 - c0) * m) AS BIGINT) AS c FROM m JOIN p USING (event_id) WHERE m IS NOT NULL""")
def dda_cells(t: Tables):
    rays = _rays(t)
    cells = voxels.traversed([F.col(x) for x in ("oz", "or_", "oc")], [F.col(x) for x in ("ez", "er", "ec")])
    return rays.select("event_id", F.posexplode(cells).alias("pos", "v")).select("event_id", "pos", "v.z", "v.r", "v.c")


@query("ray_events", DDA + """, k AS (SELECT event_id, pos, count(*) OVER (PARTITION BY event_id) AS n, CAST(floor(z0 + (z1 - z0) * m) AS BIGINT) AS z, CAST(floor(r0 + (r1 - r0) * m) AS BIGINT) AS r, CAST(floor(c0 + (c1 - c0) * m) AS BIGINT) AS c FROM m JOIN p USING (event_id) WHERE m IS NOT NULL),
f AS (SELECT k.*, e.step, e.occ FROM k JOIN e USING (event_id)),
ev AS (SELECT step, z, r, c, 1 AS free, 0 AS occupied FROM f WHERE NOT occ OR pos < n - 1 UNION ALL SELECT e.step, CAST(floor(z1) AS BIGINT), CAST(floor(r1) AS BIGINT), CAST(floor(c1) AS BIGINT), 0, 1 FROM p JOIN e USING (event_id) WHERE e.occ)
SELECT step, z, r, c, CAST(sum(free) AS BIGINT) AS free, CAST(sum(occupied) AS BIGINT) AS occupied FROM ev GROUP BY ALL""")
def ray_events(t: Tables):
    return voxels.ray_events(_rays(t), ["step"], (8, 40, 64))


@query("clip_segments", "SELECT event_id, round(greatest(0.0, CASE WHEN dx = 0 THEN 0 ELSE least(-x / dx, (50 - x) / dx) END), 6) AS t0, round(least(1.0, CASE WHEN dx = 0 THEN 1 ELSE greatest(-x / dx, (50 - x) / dx) END), 6) AS t1 FROM (SELECT event_id, CAST(user_id - 40 AS DOUBLE) AS x, CAST(event_id % 90 - (user_id - 40) AS DOUBLE) AS dx FROM events) WHERE NOT (dx = 0 AND (x < 0 OR x >= 50)) AND greatest(0.0, CASE WHEN dx = 0 THEN 0 ELSE least(-x / dx, (50 - x) / dx) END) <= least(1.0, CASE WHEN dx = 0 THEN 1 ELSE greatest(-x / dx, (50 - x) / dx) END)")
def clip_segments(t: Tables):
    a, b = F.expr("cast(user_id - 40 as double)"), F.expr("cast(event_id % 90 as double)")
    return t.events.select("event_id", voxels.clipped([a], [b], [50]).alias("k")).where("k is not null").select("event_id", "k.t0", "k.t1")


VOXEL = "v AS (SELECT step, z, r % 10 AS r, c % 10 AS c, count(*) FILTER (NOT occ) AS free, count(*) FILTER (occ) AS occupied FROM e GROUP BY ALL)"


def _voxel_events(t: Tables):
    return t.e.selectExpr("step", "z", "r % 10 as r", "c % 10 as c", "occ").groupBy("step", "z", "r", "c").agg(F.count(F.when(~F.col("occ"), 1)).alias("free"), F.count(F.when(F.col("occ"), 1)).alias("occupied"))


@query("event_count_by_voxel", f"WITH {VOXEL} SELECT * FROM v")
def event_count_by_voxel(t: Tables):
    return _voxel_events(t)


FOLD = f"""WITH {VOXEL}, o AS (SELECT *, row_number() OVER (PARTITION BY z, r, c ORDER BY step) AS n FROM v),
f(z, r, c, n, v, s) AS (SELECT DISTINCT z, r, c, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM v
UNION ALL SELECT z, r, c, n, w, CASE WHEN w >= 1 THEN 2 WHEN w <= -1 AND (s <> 2 OR w <= -6) THEN 1 ELSE s END FROM (
SELECT f.z, f.r, f.c, o.n, f.s, greatest(-20, least(20, greatest(-20, least(20, f.v - CASE WHEN o.occupied > 0 THEN 0 ELSE least(o.free, 1) END)) + 4 * least(o.occupied, 3))) AS w FROM f JOIN o ON o.z = f.z AND o.r = f.r AND o.c = f.c AND o.n = f.n + 1)),
state AS (SELECT z, r, c, arg_max(v, n) AS log_odds, arg_max(s, n) AS state FROM f GROUP BY ALL)"""


@query("logodds_fold", f"{FOLD} SELECT * FROM state", recursive=True)
def logodds_fold(t: Tables):
    return voxels.folded(_voxel_events(t), ["z", "r", "c"])


def _state(t: Tables):
    return voxels.folded(_voxel_events(t), ["z", "r", "c"]).withColumn("scene", F.lit(1))


@query("nav_projection", f"{FOLD} SELECT r, c, bool_or(state = 2 AND z BETWEEN 1 AND 3) AS occupied, NOT bool_or(state = 2 AND z BETWEEN 1 AND 3) AND count(*) FILTER (state = 1) >= 1 AS free FROM state GROUP BY ALL", recursive=True)
def nav_projection(t: Tables):
    return voxels.projected(_state(t), ["scene"], (1, 3), (0, 7)).select("r", "c", "occupied", "free")


@query("ceiling_peak", f"{FOLD} SELECT z AS ceiling_z, count(*) AS peak FROM state WHERE state = 2 AND z BETWEEN 2 AND 7 GROUP BY z ORDER BY peak DESC, ceiling_z DESC LIMIT 1", recursive=True)
def ceiling_peak(t: Tables):
    return voxels.ceiling_peak(_state(t), ["scene"], (2, 7)).select("ceiling_z", "peak")


def _columns(t: Tables):
    """Every bin of small columns, with a state and a count of frames that saw it."""
    return t.e.selectExpr("1 as scene", "event_id div 16 as r", "0 as c", "event_id % 16 as z", "case when event_id % 16 < 7 then if(user_id % 9 = 0, 0, 1) when event_type in ('error', 'purchase', 'view') then 2 when user_id % 2 = 0 then 0 else if(user_id % 5 = 0, 1, 2) end as state", "user_id % 3 as seen")


COLUMNS = "col AS (SELECT event_id // 16 AS r, event_id % 16 AS z, CASE WHEN event_id % 16 < 7 THEN CASE WHEN user_id % 9 = 0 THEN 0 ELSE 1 END WHEN event_type IN ('error', 'purchase', 'view') THEN 2 WHEN user_id % 2 = 0 THEN 0 ELSE CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END END AS state, user_id % 3 AS seen FROM e)"


@query("column_classify", f"WITH {COLUMNS}, k AS (SELECT r, count(*) AS n, count(*) FILTER (state = 1) AS n_free, count(*) FILTER (state = 2) AS n_occupied, count(*) FILTER (state = 0 AND seen >= 1) AS n_unknown_in_range, count(*) FILTER (state = 0 AND seen < 1) AS n_unknown_out_of_range FROM col GROUP BY r) SELECT *, CASE WHEN n_free > 0 AND n_free / greatest(n_free + n_occupied + n_unknown_in_range, 1) >= 0.5 THEN 'free' WHEN n_occupied > 0 AND n_occupied / greatest(n_free + n_occupied + n_unknown_in_range, 1) >= 0.3 THEN 'wall' ELSE 'unknown' END AS class FROM k")
def column_classify(t: Tables):
    return voxels.column_classes(_columns(t), ["scene"]).drop("scene", "c", "free_ratio", "wall_ratio")


@query("door_seed_reason", f"""WITH {COLUMNS}, h AS (SELECT *, 0.0::DOUBLE + (z + 0.5) * 0.2::DOUBLE AS h FROM col),
a AS (SELECT r, count(*) FILTER (state = 1) AS nf, count(*) FILTER (state = 2) AS no, avg(h) FILTER (state = 1) AS fc, avg(h) FILTER (state = 2) AS oc, round_even((max(h) FILTER (state = 1) - min(h) FILTER (state = 1)) / 0.2::DOUBLE, 0) + 1 AS span, min(h) AS bottom, max(h) AS top FROM h GROUP BY r),
b AS (SELECT *, round(fc + 0.5 * greatest(nf, coalesce(span, 0)) * 0.2::DOUBLE, 6) AS turn FROM a),
g AS (SELECT b.r, turn, nf, no, fc, oc, bottom, top, count(*) FILTER (NOT coalesce(h.h >= turn, false)) AS lower, count(*) FILTER (NOT coalesce(h.h >= turn, false) AND state = 1) AS lf, count(*) FILTER (h.h >= turn) AS upper, count(*) FILTER (h.h >= turn AND state = 2) AS uo, count(*) FILTER (h.h >= turn AND (state = 2 OR (state = 0 AND seen <= 0))) AS us, count(*) FILTER (h.h >= turn AND state = 0 AND seen > 0) AS ud, count(*) FILTER (h.h >= turn AND state = 1) AS uf FROM b JOIN h ON h.r = b.r GROUP BY ALL)
SELECT r, CASE WHEN nf < 4 THEN 'lower_free_cells_too_few' WHEN no < 1 THEN 'upper_occupied_cells_too_few' WHEN turn IS NULL OR turn < bottom - 0.000001 OR turn > top + 0.1 + 0.000001 THEN 'turn_outside_active_range' WHEN turn < 1.2 THEN 'turn_z_below_door_lintel_min' WHEN lower < 4 THEN 'lower_free_cells_too_few' WHEN lf / greatest(lower, 1) < 0.5 THEN 'lower_free_ratio_too_low' WHEN upper < 1 THEN 'upper_observed_cells_too_few' WHEN uo = 0 THEN 'upper_actual_occupied_cells_too_few' WHEN us / greatest(upper, 1) < 0.8 THEN 'upper_generalized_solid_ratio_too_low' WHEN ud / greatest(upper, 1) > 0.25 THEN 'upper_in_range_unknown_ratio_too_high' WHEN uf / greatest(upper, 1) > 0.15 THEN 'upper_free_ratio_too_high' WHEN NOT coalesce(oc > fc, false) THEN 'occupied_centroid_not_above_free_centroid' ELSE 'accepted' END AS reason FROM g""")
def door_seed_reason(t: Tables):
    rules = voxels.DoorSeedRules(z_step=0.2, turn_min_m=1.2)
    return voxels.door_seed_reasons(_columns(t), ["scene"], rules).select("r", "reason")


@query("saturating_seen", "SELECT z, r, c, least(3, count(DISTINCT step)) AS seen FROM e GROUP BY ALL")
def saturating_seen(t: Tables):
    return voxels.seen_counts(t.e, ["z", "r", "c"], most=3)


@query("decayed_seen", "WITH s AS (SELECT DISTINCT r, c, step FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY step) AS n FROM s), f(r, c, n, v, t) AS (SELECT DISTINCT r, c, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s UNION ALL SELECT f.r, f.c, o.n, least(9, greatest(0, f.v - (o.step - f.t)) + 4), o.step FROM f JOIN o ON o.r = f.r AND o.c = f.c AND o.n = f.n + 1) SELECT r, c, greatest(0, arg_max(v, n) - (250 - arg_max(t, n))) AS seen FROM f GROUP BY ALL", recursive=True)
def decayed_seen(t: Tables):
    return voxels.decayed_counts(t.e, ["r", "c"], 250, delta=4, decay=1, most=9)


@query("endpoint_scores", "WITH s AS (SELECT r, c, step, bool_or(occ) AS hit, bool_or(NOT occ) AS crossed FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY step) AS n FROM s), f(r, c, n, v) AS (SELECT DISTINCT r, c, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s UNION ALL SELECT f.r, f.c, o.n, greatest(0, least(65535, f.v + CASE WHEN hit THEN 2 ELSE 0 END) - CASE WHEN crossed THEN 1 ELSE 0 END) FROM f JOIN o ON o.r = f.r AND o.c = f.c AND o.n = f.n + 1) SELECT r, c, arg_max(v, n) AS score FROM f GROUP BY ALL", recursive=True)
def endpoint_scores(t: Tables):
    return voxels.endpoint_scores(t.e.select("r", "c", "step", F.col("occ").alias("hit"), (~F.col("occ")).alias("crossed")), ["r", "c"])


@query("outside_scores", "WITH s AS (SELECT r, c, step, bool_or(z < 3) AS candidate, bool_or(event_type = 'error') AS cleared FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY step) AS n FROM s), f(r, c, n, v) AS (SELECT DISTINCT r, c, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s UNION ALL SELECT f.r, f.c, o.n, CASE WHEN cleared THEN 0 WHEN candidate THEN least(255, f.v + 1) ELSE greatest(0, f.v - 1) END FROM f JOIN o ON o.r = f.r AND o.c = f.c AND o.n = f.n + 1) SELECT r, c, arg_max(v, n) AS score, arg_max(v, n) >= 2 AS outside FROM f GROUP BY ALL", recursive=True)
def outside_scores(t: Tables):
    frames = t.e.groupBy("r", "c", "step").agg(F.max(F.col("z") < 3).alias("candidate"), F.max(F.col("event_type") == "error").alias("cleared"))
    return voxels.outside_scores(frames, ["r", "c"])


@query("forced_free", "WITH v AS (SELECT event_id AS k, event_id % 41 - 20 AS log_odds, event_id % 3 AS state FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id AS k FROM events WHERE event_id % 3 = 0) SELECT coalesce(v.k, f.k) AS k, CASE WHEN f.k IS NOT NULL THEN least(coalesce(log_odds, 0), -6) ELSE log_odds END AS log_odds, CASE WHEN f.k IS NOT NULL THEN 1 ELSE state END AS state FROM v FULL OUTER JOIN f ON v.k = f.k")
def forced_free(t: Tables):
    v = t.events.where("event_id % 2 = 0").selectExpr("event_id as k", "event_id % 41 - 20 as log_odds", "event_id % 3 as state")
    return voxels.forced_free(v, ["k"], t.events.where("event_id % 3 = 0").selectExpr("event_id as k"))


@query("ceiling_lock", "WITH s AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), n AS (SELECT *, count(v) OVER w AS k FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), h AS (SELECT *, first_value(CASE WHEN k = 3 AND v IS NOT NULL THEN v END IGNORE NULLS) OVER w AS held, last_value(v IGNORE NULLS) OVER w AS latest FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, round(coalesce(held, latest), 6) AS height, held IS NOT NULL AS locked FROM h")
def ceiling_lock(t: Tables):
    rows = t.events.selectExpr("user_id", "event_id", "case when event_type <> 'error' then value end as v")
    return voxels.locked_ceiling(rows, ["user_id"], "event_id", "v", 3).select("user_id", "event_id", "height", "locked")


@query("frustum", "SELECT event_id, coalesce(z BETWEEN 0.2 AND 5 AND 300 * x / nullif(z, 0) + 319.5 >= 0 AND 300 * x / nullif(z, 0) + 319.5 < 640 AND 300 * y / nullif(z, 0) + 239.5 >= 0 AND 300 * y / nullif(z, 0) + 239.5 < 480, false) AS inside FROM (SELECT event_id, CAST(user_id % 7 - 3 AS DOUBLE) AS x, CAST(event_id % 5 - 2 AS DOUBLE) AS y, value / 60 AS z FROM events)")
def frustum(t: Tables):
    x, y, z = F.expr("cast(user_id % 7 - 3 as double)"), F.expr("cast(event_id % 5 - 2 as double)"), F.col("value") / 60
    return t.events.select("event_id", voxels.in_frustum(x, y, z, 300, 300, 319.5, 239.5, 640, 480, 0.2, 5.0).alias("inside"))


@query("scalar_scores", "SELECT event_id, round(greatest(0.0, least(1.0, 1 - (value / 100 - 0.5) / 3.0)), 6) AS nearness, CASE WHEN value / 1000 < 0.1 THEN 'Infinity'::DOUBLE ELSE round(2.0 * pow(greatest(0.0, 0.4 - value / 1000) / 0.4, 2.0), 6) END AS penalty, round(sqrt(pow(greatest(3.0 - user_id, user_id - 20.0, 0), 2) + pow(greatest(5.0 - event_id % 50, event_id % 50 - 9.0, 0), 2)), 6) AS to_box FROM events")
def scalar_scores(t: Tables):
    v = F.col("value")
    box = scalar.point_box_distance(F.col("user_id").cast("double"), (F.col("event_id") % 50).cast("double"), F.lit(3.0), F.lit(5.0), F.lit(20.0), F.lit(9.0))
    return t.events.select("event_id", scalar.inverse_distance(v / 100, 0.5, 3.0).alias("nearness"), scalar.clearance_penalty(v / 1000, 0.4, 0.1, 2.0, 2.0).alias("penalty"), box.alias("to_box"))


@query("line_angles", "SELECT event_id, round(degrees(acos(least(1.0, abs(a * 3 + b * 4) / nullif(sqrt(a * a + b * b) * 5.0, 0)))), 6) AS angle FROM (SELECT event_id, CAST(user_id % 9 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) AS b FROM events)")
def line_angles(t: Tables):
    return t.events.select("event_id", scalar.line_angle_deg(F.expr("cast(user_id % 9 as double)"), F.expr("cast(event_id % 5 as double)"), F.lit(3.0), F.lit(4.0)).alias("angle"))


@query("polygon_area", "SELECT s_suppkey, round(abs(x * 5 - 0 + (3 + x) * 7 - 5 * 2 + 2 * 0 - 7 * 0) / 2, 6) AS area FROM (SELECT s_suppkey, CAST(s_suppkey % 11 AS DOUBLE) AS x FROM supplier)")
def polygon_area(t: Tables):
    points = F.expr("array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', cast(s_suppkey % 11 as double), 'y', 0.0D), named_struct('x', 3.0D + s_suppkey % 11, 'y', 5.0D), named_struct('x', 2.0D, 'y', 7.0D))")
    return t.supplier.select("s_suppkey", scalar.polygon_area(points).alias("area"))


@query("active_top", "SELECT event_id, round(least(coalesce(CASE WHEN user_id % 4 > 0 THEN value / 100 END * 0.95, 2.4), 3.5), 6) AS top FROM events")
def active_top(t: Tables):
    known = F.when(F.col("user_id") % 4 > 0, F.col("value") / 100)
    return t.events.select("event_id", coords.active_z_top(known, 0.95, 2.4, 3.5).alias("top"))
