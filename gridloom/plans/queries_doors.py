"""Queries over door seeds, walks to walls and wall segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts, raster, rooms, routes, runs, seed_lines, separators, voxels, wall_lines
from .registry import Tables, query, rounded


def _seeds(t: Tables):
    """Order lines as seed cells, groups of 64 order keys each, of four kinds: a row with short branches, a row alone, a row with wide branches, two rows six apart."""
    at = "l_orderkey % 64 * 2 + (l_linenumber - 1) % 4 div 2"
    row = """case l_orderkey div 64 % 4 when 0 then if(l_linenumber = 7, 4 + l_orderkey % 3, 3) when 1 then 3
      when 2 then case when l_linenumber > 5 then l_linenumber - 2 when l_linenumber = 5 then 9 else 3 end else case when l_linenumber in (4, 5) then 9 else 3 + l_linenumber % 2 end end"""
    return t.lineitem.selectExpr("l_orderkey div 64 as group_id", f"cast({row} as int) as r", f"cast({at} as int) as c")


SEEDS = """seed AS (SELECT DISTINCT l_orderkey // 64 AS g,
  CASE l_orderkey // 64 % 4 WHEN 0 THEN CASE WHEN l_linenumber = 7 THEN 4 + l_orderkey % 3 ELSE 3 END WHEN 1 THEN 3
    WHEN 2 THEN CASE WHEN l_linenumber > 5 THEN l_linenumber - 2 WHEN l_linenumber = 5 THEN 9 ELSE 3 END ELSE CASE WHEN l_linenumber IN (4, 5) THEN 9 ELSE 3 + l_linenumber % 2 END END AS r,
  l_orderkey % 64 * 2 + (l_linenumber - 1) % 4 // 2 AS c FROM lineitem),
ax AS (SELECT g, 'h' AS axis, r AS line, c AS pos, 0 AS met FROM seed UNION ALL SELECT g, 'v', c, r, min(r) OVER (PARTITION BY g, c) FROM seed),
step AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY g, axis, line ORDER BY pos) > 3 THEN 1 ELSE 0 END AS brk FROM ax),
piece AS (SELECT *, sum(brk) OVER (PARTITION BY g, axis, line ORDER BY pos) AS run FROM step),
runs AS (SELECT g, axis, met, line, run, min(pos) AS first, max(pos) AS last, count(*) AS n FROM piece GROUP BY ALL)"""

PARALLEL = """mid AS (SELECT g, avg(r) AS mr, avg(c) AS mc FROM seed GROUP BY g),
long AS (SELECT runs.*, abs(line - CASE WHEN axis = 'h' THEN mr ELSE mc END) AS off FROM runs JOIN mid USING (g) WHERE n >= 7),
pair AS (SELECT a.g, a.axis, a.met AS am, a.line AS al, a.run AS ar, b.met AS bm, b.line AS bl, b.run AS br, a.n AS an, b.n AS bn, abs(a.line - b.line) AS distance,
  greatest(0, least(a.last, b.last) - greatest(a.first, b.first) + 1) / greatest(1, least(a.last - a.first + 1, b.last - b.first + 1)) AS overlap,
  (-a.n, -a.off, a.line) > (-b.n, -b.off, b.line) AS better, a.first AS af, a.last AS az, b.first AS bf, b.last AS bz
  FROM long a JOIN long b ON a.g = b.g AND a.axis = b.axis AND (a.met, a.line, a.run) < (b.met, b.line, b.run) WHERE abs(a.line - b.line) BETWEEN 1 AND 8 AND abs(a.n - b.n) / greatest(a.n, b.n, 1) <= 0.25 + 1e-6),
scored AS (SELECT *, overlap + 0.01::DOUBLE * least(an, bn) - 0.001::DOUBLE * distance AS score, CASE WHEN better THEN al ELSE bl END AS line, CASE WHEN better THEN af ELSE bf END AS first, CASE WHEN better THEN az ELSE bz END AS last,
  CASE WHEN better THEN an ELSE bn END AS kept, CASE WHEN better THEN bn ELSE an END AS removed FROM pair WHERE overlap + 1e-6 >= 0.7),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY g, axis, line, first ORDER BY score DESC, axis, am, al, ar, bm, bl, br) = 1),
par AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY score DESC, axis, am, al, ar, bm, bl, br) AS choice, axis, line, first, last, kept, removed, distance, overlap FROM one QUALIFY choice <= 4)"""

SPUR = """ln AS (SELECT g, axis, met, line, count(*) AS n, max(pos) - min(pos) + 1 AS span FROM ax GROUP BY ALL),
main AS (SELECT g, axis AS main, line AS main_line, n AS kept FROM (SELECT * FROM ln QUALIFY row_number() OVER (PARTITION BY g, axis ORDER BY n DESC, span DESC, met, line) = 1) WHERE n >= 7),
rest AS (SELECT g, main, r, c FROM seed JOIN main USING (g) WHERE CASE WHEN main = 'h' THEN r ELSE c END <> main_line),
rax AS (SELECT g, main, 'h' AS axis, r AS line, c AS pos FROM rest UNION ALL SELECT g, main, 'v', c, r FROM rest),
rstep AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY g, main, axis, line ORDER BY pos) > 3 THEN 1 ELSE 0 END AS brk FROM rax),
rpiece AS (SELECT *, sum(brk) OVER (PARTITION BY g, main, axis, line ORDER BY pos) AS run FROM rstep),
branch AS (SELECT g, main, max(n) AS branch FROM (SELECT g, main, axis, line, run, count(*) AS n FROM rpiece GROUP BY ALL) GROUP BY g, main),
gone AS (SELECT g, main, count(*) AS removed FROM rest GROUP BY g, main),
spur AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY kept DESC, removed, main DESC) AS choice, main AS axis, main_line AS line, kept, removed, branch FROM main JOIN branch USING (g, main) JOIN gone USING (g, main)
  WHERE branch / kept <= 0.35 + 1e-6 AND removed / kept <= 0.45 + 1e-6 QUALIFY choice <= 4)"""

FITS = """cand AS (SELECT g, 0 AS method, 1 AS choice, r, c FROM seed
  UNION ALL SELECT seed.g, 1, choice, r, c FROM seed JOIN par USING (g) WHERE CASE WHEN axis = 'h' THEN r ELSE c END = line AND CASE WHEN axis = 'h' THEN c ELSE r END BETWEEN first AND last
  UNION ALL SELECT seed.g, 2, choice, r, c FROM seed JOIN spur USING (g) WHERE CASE WHEN axis = 'h' THEN r ELSE c END = line),
mom AS (SELECT g, method, choice, count(*) AS n, sum(r) AS sr, sum(c) AS sc, CAST(count(*) * sum(r * r) - sum(r) * sum(r) AS DOUBLE) AS vr, CAST(count(*) * sum(c * c) - sum(c) * sum(c) AS DOUBLE) AS vc, CAST(count(*) * sum(r * c) - sum(r) * sum(c) AS DOUBLE) AS vrc FROM cand GROUP BY ALL),
axis AS (SELECT *, sr / n AS centre_r, sc / n AS centre_c, sin(0.5 * atan2(2 * vrc, vc - vr)) AS dir_r, cos(0.5 * atan2(2 * vrc, vc - vr)) AS dir_c,
  ((vr + vc) / 2 + sqrt(((vr - vc) / 2) ^ 2 + vrc ^ 2)) / (n * n) AS along_var, greatest(0.0, (vr + vc) / 2 - sqrt(((vr - vc) / 2) ^ 2 + vrc ^ 2)) / (n * n) AS across_var FROM mom),
pt AS (SELECT g, method, choice, (r - centre_r) * dir_r + (c - centre_c) * dir_c AS along, abs((c - centre_c) * dir_r - (r - centre_r) * dir_c) AS across FROM cand JOIN axis USING (g, method, choice)),
pg AS (SELECT *, along - lag(along) OVER (PARTITION BY g, method, choice ORDER BY along) AS gap FROM pt),
pr AS (SELECT *, sum(CASE WHEN gap > 3 + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY g, method, choice ORDER BY along) AS run FROM pg),
ext AS (SELECT g, method, choice, max(along) - min(along) + 1 AS length, max(across) AS residual, 2 * max(across) + 1 AS thickness, coalesce(max(gap), 0) AS max_gap FROM pr GROUP BY ALL),
lr AS (SELECT g, method, choice, max(k) AS longest_run FROM (SELECT g, method, choice, run, count(*) AS k FROM pr GROUP BY ALL) GROUP BY ALL),
fit AS (SELECT *, length / thickness AS elongation, CASE WHEN along_var + across_var <= 1e-9 THEN 1.0 ELSE sqrt(along_var / (along_var + across_var)) END AS correlation FROM axis JOIN ext USING (g, method, choice) JOIN lr USING (g, method, choice)),
judged AS (SELECT *, CASE WHEN n < 3 THEN 'primitive_too_few_seed_cells' WHEN longest_run < 7 THEN 'primitive_contiguous_seed_run_too_short' WHEN length + 1e-6 < 3 THEN 'primitive_line_too_short' WHEN thickness > 3 + 1e-6 THEN 'primitive_too_thick'
  WHEN residual > 1.75 + 1e-6 THEN 'primitive_residual_too_high' WHEN correlation + 1e-6 < 0.95 THEN 'primitive_line_correlation_too_low' WHEN across_var > 0.65 + 1e-6 THEN 'primitive_orthogonal_variance_too_high' WHEN elongation + 1e-6 < 1.4 THEN 'primitive_elongation_too_low' END AS reject_reason FROM fit),
first AS (SELECT g, min(method * 10 + choice) AS passed FROM judged WHERE reject_reason IS NULL GROUP BY g),
upto AS (SELECT judged.*, passed FROM judged LEFT JOIN first USING (g) WHERE passed IS NULL OR method * 10 + choice <= passed),
every AS (SELECT * FROM upto UNION ALL SELECT * REPLACE (3 AS method) FROM upto WHERE method = 0 AND passed IS NULL AND n >= 6)"""


@query("parallel_seed_runs", f"WITH {SEEDS}, {PARALLEL} SELECT g AS group_id, choice, axis, line, first, last, kept, removed, distance, round(overlap, 4) AS overlap FROM par")
def parallel_seed_runs(t: Tables):
    return rounded(seed_lines.parallel_runs(_seeds(t), ["group_id"]))


@query("spur_pruned_lines", f"WITH {SEEDS}, {SPUR} SELECT g AS group_id, choice, axis, line, kept, removed, branch FROM spur")
def spur_pruned_lines(t: Tables):
    return seed_lines.spur_pruned(_seeds(t), ["group_id"])


@query("seed_primitives", f"""WITH {SEEDS}, {PARALLEL}, {SPUR}, {FITS} SELECT g AS group_id, row_number() OVER (PARTITION BY g ORDER BY method, choice) AS primitive, ['direct_pca', 'parallel_pruned_main_run', 'spur_pruned_main_run', 'fallback_centerline'][method + 1] AS method,
  n, round(centre_r, 4) AS centre_r, round(centre_c, 4) AS centre_c, round(dir_r, 4) + 0 AS dir_r, round(dir_c, 4) AS dir_c, round(length, 4) AS length, round(thickness, 4) AS thickness, round(residual, 4) AS residual,
  round(elongation, 4) AS elongation, round(correlation, 4) AS correlation, round(across_var, 4) AS across_var, round(max_gap, 4) AS max_gap, 1 AS segments, longest_run, reject_reason, reject_reason IS NULL AS accepted FROM every""")
def seed_primitives(t: Tables):
    return rounded(seed_lines.primitives(_seeds(t), ["group_id"]))


H, W = 40, 64
#: Events as layers of small maps, 100 events a map: occupied ones are walls, views unknown ground, clicks seeds of other doors.
MAP = "event_id div 100 as frame, event_id, cast(user_id % 40 as int) as r, cast((event_id * 7919) % 64 as int) as c, event_type"
MAP_SQL = """m AS (SELECT event_id // 100 AS frame, event_id, user_id % 40 AS r, (event_id * 7919) % 64 AS c, event_type FROM events),
wall AS (SELECT DISTINCT frame, r, c FROM m WHERE event_type IN ('error', 'purchase')), unk AS (SELECT DISTINCT frame, r, c FROM m WHERE event_type = 'view'), oth AS (SELECT DISTINCT frame, r, c FROM m WHERE event_type = 'click')"""
#: Eight unit directions, from the columns' on.
TURN = "0.7071067811865476D"
DIRECTIONS = f"array(named_struct('r', 0D, 'c', 1D), named_struct('r', {TURN}, 'c', {TURN}), named_struct('r', 1D, 'c', 0D), named_struct('r', {TURN}, 'c', -{TURN}), named_struct('r', 0D, 'c', -1D), named_struct('r', -{TURN}, 'c', -{TURN}), named_struct('r', -1D, 'c', 0D), named_struct('r', -{TURN}, 'c', {TURN}))"
WALK = wall_lines.WalkRules(most_steps=20, snap=1, through_unknown=1)


def _map(t: Tables):
    return t.events.selectExpr(*MAP.split(", "))


WALKS = f"""WITH {MAP_SQL},
dir AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.7071067811865476, 0.7071067811865476), (2, 1.0, 0.0), (3, 0.7071067811865476, -0.7071067811865476), (4, 0.0, -1.0), (5, -0.7071067811865476, -0.7071067811865476), (6, -1.0, 0.0), (7, -0.7071067811865476, 0.7071067811865476)) d(k, dr, dc)),
st AS (SELECT frame, event_id AS w, dr, dc, step, CAST(round_even(r + dr * step, 0) AS BIGINT) AS r, CAST(round_even(c + dc * step, 0) AS BIGINT) AS c FROM m JOIN dir ON event_id % 8 = k, range(1, 21) s(step)),
off AS (SELECT a - 1 AS a, b - 1 AS b FROM range(0, 3) x(a), range(0, 3) y(b)),
near AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM wall, off WHERE r + a BETWEEN 0 AND 39 AND c + b BETWEEN 0 AND 63),
shade AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM wall, off WHERE a * b = 0),
strip AS (SELECT st.*, k - 1 AS k, CAST(round_even(r - dc * (k - 1), 0) AS BIGINT) AS sr, CAST(round_even(c + dr * (k - 1), 0) AS BIGINT) AS sc FROM st, range(0, 3) g(k) WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 63),
seen AS (SELECT DISTINCT w, step FROM strip JOIN near ON near.frame = strip.frame AND near.r = sr AND near.c = sc),
k AS (SELECT st.*, CASE WHEN st.r NOT BETWEEN 0 AND 39 OR st.c NOT BETWEEN 0 AND 63 THEN 'out_of_bounds' WHEN seen.w IS NOT NULL THEN 'hit_wall' WHEN oth.r IS NOT NULL THEN 'other' WHEN unk.r IS NOT NULL AND shade.r IS NULL THEN 'unknown' ELSE 'clear' END AS kind
  FROM st LEFT JOIN seen USING (w, step) LEFT JOIN oth ON oth.frame = st.frame AND oth.r = st.r AND oth.c = st.c LEFT JOIN unk ON unk.frame = st.frame AND unk.r = st.r AND unk.c = st.c LEFT JOIN shade ON shade.frame = st.frame AND shade.r = st.r AND shade.c = st.c),
s AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY step) AS stretch FROM k),
u AS (SELECT *, sum(CASE WHEN kind = 'unknown' THEN 1 ELSE 0 END) OVER (PARTITION BY w, stretch ORDER BY step) AS n FROM s),
ev AS (SELECT *, CASE WHEN kind IN ('out_of_bounds', 'hit_wall') THEN kind WHEN kind = 'unknown' AND n > 1 THEN 'too_much_unknown' END AS ends FROM u),
l AS (SELECT *, coalesce(min(CASE WHEN ends IS NOT NULL THEN step END) OVER (PARTITION BY w), 20) AS final FROM ev),
g AS (SELECT frame, w, coalesce(max(ends), 'extend_max_without_wall') AS status, max(step) AS steps, count(*) FILTER (kind = 'other') AS other_hits, count(*) FILTER (kind = 'unknown') AS unknown_hits FROM l WHERE step <= final GROUP BY frame, w),
p AS (SELECT strip.*, wall.r AS wr, wall.c AS wc, round(sqrt((wall.r - strip.r) ^ 2 + (wall.c - strip.c) ^ 2) + 0.01::DOUBLE * abs((wall.c - strip.c) * dr - (wall.r - strip.r) * dc), 6) AS cost
  FROM strip JOIN g ON g.w = strip.w AND g.steps = strip.step AND g.status = 'hit_wall' JOIN wall ON wall.frame = strip.frame AND wall.r BETWEEN sr - 1 AND sr + 1 AND wall.c BETWEEN sc - 1 AND sc + 1 WHERE sr BETWEEN 0 AND 39 AND sc BETWEEN 0 AND 63),
b AS (SELECT w, wr, wc FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY cost, k, wr, wc) = 1)
SELECT frame, w AS walk_id, status, steps, coalesce(wr, -1) AS anchor_r, coalesce(wc, -1) AS anchor_c, other_hits, unknown_hits FROM g LEFT JOIN b USING (w)"""


@query("wall_walks", WALKS)
def wall_walks(t: Tables):
    m = _map(t)
    layer = lambda *kinds: m.where(F.col("event_type").isin(*kinds))
    starts = m.withColumn("d", F.element_at(F.expr(DIRECTIONS), (F.col("event_id") % 8 + 1).cast("int"))).selectExpr("frame", "event_id as walk_id", "r", "c", "d.r as dir_r", "d.c as dir_c")
    got = wall_lines.walks(starts, layer("error", "purchase"), ["frame"], H, W, other=layer("click"), unknown=layer("view"), rules=WALK)
    return got.select("frame", "walk_id", "status", "steps", *[F.coalesce(f"anchor.{x}", F.lit(-1)).alias(f"anchor_{x}") for x in "rc"], "other_hits", "unknown_hits")


NECKS = f"""WITH {MAP_SQL}, door AS (SELECT frame, event_id, event_id % 3 = 0 AS diag, k - 5 AS pos, r + CASE WHEN event_id % 3 = 0 THEN k - 5 ELSE 0 END AS r, c + k - 5 AS c FROM m, range(0, 11) g(k)),
line AS (SELECT * FROM door WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 63),
seed AS (SELECT DISTINCT frame, r, c FROM m WHERE event_type = 'signup'), free AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM m, range(-3, 4) x(a), range(-3, 4) y(b) WHERE a * a + b * b <= 9 AND event_type NOT IN ('error', 'purchase') AND r + a BETWEEN 0 AND 39 AND c + b BETWEEN 0 AND 63),
d2 AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM seed, range(-2, 3) x(a), range(-2, 3) y(b) WHERE a * a + b * b <= 4), d1 AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM seed, range(-1, 2) x(a), range(-1, 2) y(b) WHERE a * a + b * b <= 1),
real AS (SELECT DISTINCT frame, r, c FROM m WHERE event_type = 'purchase'),
x AS (SELECT line.*, pos > min(pos) OVER (PARTITION BY event_id) AND pos < max(pos) OVER (PARTITION BY event_id) AS inn FROM line),
edge AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM free, range(-1, 2) x(a), range(-1, 2) y(b) WHERE r + a BETWEEN 0 AND 39 AND c + b BETWEEN 0 AND 63 EXCEPT SELECT * FROM free),
bar AS (SELECT * FROM wall UNION SELECT * FROM real UNION SELECT * FROM edge UNION SELECT * FROM (SELECT DISTINCT frame, r, c FROM x WHERE inn EXCEPT SELECT * FROM free)),
dist AS (SELECT i.frame, i.r, i.c, min((i.r - bar.r) ^ 2 + (i.c - bar.c) ^ 2) AS q FROM (SELECT DISTINCT frame, r, c FROM x WHERE inn) i JOIN bar ON bar.frame = i.frame AND bar.r BETWEEN i.r - 5 AND i.r + 5 AND bar.c BETWEEN i.c - 5 AND i.c + 5 GROUP BY ALL HAVING q <= 25),
y AS (SELECT x.*, d2.r IS NOT NULL AS near, d1.r IS NOT NULL AS at1, wall.r IS NOT NULL AS w, real.r IS NOT NULL AS re, q FROM x LEFT JOIN d2 USING (frame, r, c) LEFT JOIN d1 USING (frame, r, c) LEFT JOIN wall USING (frame, r, c) LEFT JOIN real USING (frame, r, c) LEFT JOIN dist USING (frame, r, c)),
z AS (SELECT frame, event_id, count(*) AS cells, bool_or(near) AS seed_overlap, count(*) FILTER (inn AND re AND NOT at1) AS inner_walls, count(*) FILTER (w) AS onw, bool_or(diag) AS diag, CASE WHEN count(*) FILTER (inn AND q IS NULL) = 0 THEN CAST(coalesce(max(CASE WHEN inn THEN q END), 0) AS BIGINT) END AS open_d2 FROM y GROUP BY frame, event_id)
SELECT frame, event_id AS line_id, cells, seed_overlap, inner_walls, coalesce(open_d2, -1) AS open_d2, CASE WHEN NOT seed_overlap THEN 'door_line_no_seed_overlap' WHEN inner_walls > 1 THEN 'door_line_crosses_real_wall' WHEN diag AND onw < 2 THEN 'door_diagonal_without_support' WHEN coalesce(open_d2 > 16, true) THEN 'door_line_crosses_large_open_free' END AS reject_reason FROM z"""


@query("door_necks", NECKS)
def door_necks(t: Tables):
    m = _map(t)
    layer = lambda *kinds: m.where(F.col("event_type").isin(*kinds))
    lines = m.withColumn("pos", F.explode(F.sequence(F.lit(-5), F.lit(5)))).withColumn("diagonal", F.col("event_id") % 3 == 0)
    lines = lines.select("frame", F.col("event_id").alias("line_id"), "pos", (F.col("r") + F.when(F.col("diagonal"), F.col("pos")).otherwise(0)).alias("r"), (F.col("c") + F.col("pos")).alias("c"), "diagonal").where(raster.within(H, W))
    free = raster.dilate(m.where("event_type not in ('error', 'purchase')"), ["frame"], raster.disk(3), H, W)
    rules = wall_lines.WalkRules(most_inner_walls=1, reject_open=True, least_open=4.0, most_width=4.0)
    return wall_lines.neck_reasons(lines, layer("signup"), layer("error", "purchase"), layer("purchase"), free, ["frame"], H, W, rules).withColumn("open_d2", F.coalesce("open_d2", F.lit(-1)))


EXTENSIONS = f"""WITH {MAP_SQL}, line AS (SELECT DISTINCT frame, event_id, r, c + k AS c FROM m, range(0, 12) g(k)), occ AS (SELECT DISTINCT frame, r + a AS r, c + b AS c FROM m, range(-2, 3) x(a), range(-2, 3) y(b) WHERE event_type = 'click'),
left_ AS (SELECT line.* FROM line ANTI JOIN (SELECT event_id, r, c FROM m) a USING (event_id, r, c) ANTI JOIN wall USING (frame, r, c)), hit AS (SELECT left_.* FROM left_ SEMI JOIN occ USING (frame, r, c)),
around AS (SELECT hit.frame, event_id, hit.r, hit.c, count(*) AS n FROM hit, range(-1, 2) x(a), range(-1, 2) y(b), occ WHERE occ.frame = hit.frame AND occ.r = hit.r + a AND occ.c = hit.c + b GROUP BY ALL),
sums AS (SELECT frame, event_id, count(*) FILTER (n = 9) AS occupied, count(*) FILTER (n < 9) AS surface FROM around GROUP BY ALL)
SELECT frame, event_id AS line_id, coalesce(occupied, 0) AS occupied, coalesce(surface, 0) AS surface, coalesce(occupied, 0) >= 3 AS rejected FROM (SELECT DISTINCT frame, event_id FROM line) LEFT JOIN sums USING (frame, event_id)"""


@query("occupied_extensions", EXTENSIONS)
def occupied_extensions(t: Tables):
    m = _map(t).withColumnRenamed("event_id", "line_id")
    lines = m.withColumn("c", F.explode(F.sequence(F.col("c"), F.col("c") + 11)))
    occupied = raster.moved(m.where("event_type = 'click'"), ["frame"], raster.square(2))
    return wall_lines.occupied_extensions(lines, occupied, m.where("event_type in ('error', 'purchase')"), m, ["frame"])


def _walls(t: Tables):
    """Order lines as walls: three components a map, a slanting one among them."""
    lines = t.lineitem.selectExpr("l_orderkey div 64 as frame", "cast(l_linenumber % 3 as int) as label", "cast(l_orderkey % 64 * 2 + l_linenumber % 2 as int) as c", "cast(l_linenumber % 3 * 8 + if(l_linenumber % 3 = 1, l_orderkey % 64 div 4, l_linenumber div 4) as int) as r", "l_quantity / 50 as ratio")
    return lines.groupBy("frame", "label", "r", "c").agg(F.max("ratio").alias("ratio"))


WALL_CELLS = """wl AS (SELECT l_orderkey // 64 AS frame, l_linenumber % 3 AS label, l_linenumber % 3 * 8 + CASE WHEN l_linenumber % 3 = 1 THEN l_orderkey % 64 // 4 ELSE l_linenumber // 4 END AS r, l_orderkey % 64 * 2 + l_linenumber % 2 AS c, max(l_quantity / 50) AS ratio FROM lineitem GROUP BY ALL)"""
LINE = """CAST(round_even(r0 + (r1 - r0) * i / CAST(greatest(abs(r1 - r0), abs(c1 - c0), 1) AS DOUBLE), 0) AS BIGINT) AS r, CAST(round_even(c0 + (c1 - c0) * i / CAST(greatest(abs(r1 - r0), abs(c1 - c0), 1) AS DOUBLE), 0) AS BIGINT) AS c"""


@query("pca_segments", f"""WITH {WALL_CELLS}, mo AS (SELECT frame, label, count(*) AS n, sum(r) AS sr, sum(c) AS sc, CAST(count(*) * sum(r * r) - sum(r) * sum(r) AS DOUBLE) AS vr, CAST(count(*) * sum(c * c) - sum(c) * sum(c) AS DOUBLE) AS vc, CAST(count(*) * sum(r * c) - sum(r) * sum(c) AS DOUBLE) AS vrc, greatest(max(r) - min(r), max(c) - min(c)) + 1 AS side FROM wl GROUP BY ALL HAVING n >= 2),
f AS (SELECT *, sr / n AS cr, sc / n AS cc, 0.5 * atan2(2 * vrc, vc - vr) AS th, (vr + vc) / 2 AS half, sqrt(((vr - vc) / 2) ^ 2 + vrc ^ 2) AS root FROM mo),
g AS (SELECT * FROM f WHERE side * 0.05 >= 0.45 AND sqrt(greatest((half + root) / (n * (n - 1)), 1e-6) / greatest(greatest(half - root, 0) / (n * (n - 1)), 1e-6)) >= 1.5),
ev AS (SELECT frame, label, cr, cc, th, min((r - cr) * sin(th) + (c - cc) * cos(th)) AS t0, max((r - cr) * sin(th) + (c - cc) * cos(th)) AS t1 FROM wl JOIN g USING (frame, label) GROUP BY ALL),
s AS (SELECT frame, label, cr + sin(th) * t0 AS p0r, cc + cos(th) * t0 AS p0c, cr + sin(th) * t1 AS p1r, cc + cos(th) * t1 AS p1c, th, (t1 - t0) * 0.05::DOUBLE AS length_m FROM ev WHERE (t1 - t0) * 0.05::DOUBLE >= 0.45),
q AS (SELECT frame, label, CAST(round_even(p0r, 0) AS BIGINT) AS r0, CAST(round_even(p0c, 0) AS BIGINT) AS c0, CAST(round_even(p1r, 0) AS BIGINT) AS r1, CAST(round_even(p1c, 0) AS BIGINT) AS c1 FROM s),
d AS (SELECT frame, label, {LINE} FROM (SELECT *, unnest(range(0, greatest(abs(r1 - r0), abs(c1 - c0)) + 1)) AS i FROM q)),
sup AS (SELECT d.frame, d.label, count(w.r) / count(*) AS support FROM d LEFT JOIN (SELECT DISTINCT frame, r, c FROM wl) w USING (frame, r, c) WHERE d.r BETWEEN 0 AND 39 AND d.c BETWEEN 0 AND 127 GROUP BY ALL)
SELECT frame, label, round(p0r, 4) AS p0_r, round(p0c, 4) AS p0_c, round(p1r, 4) AS p1_r, round(p1c, 4) AS p1_c, round(th, 4) + 0 AS theta, round(length_m, 4) AS length_m, round(support, 4) AS support FROM s JOIN sup USING (frame, label) WHERE support >= 0.35""")
def pca_segments(t: Tables):
    w = _walls(t)
    got = wall_lines.component_segments(w, w, ["frame"], 40, 128)
    return rounded(got.select("frame", "label", *[F.col(f"{p}.{x}").alias(f"{p}_{x}") for p in ("p0", "p1") for x in "rc"], "theta", "length_m", "support"))


@query("projected_components", f"""WITH {WALL_CELLS}, mo AS (SELECT frame, label, count(*) AS n, sum(greatest(ratio, 1e-3) * r) / sum(greatest(ratio, 1e-3)) AS wr, sum(greatest(ratio, 1e-3) * c) / sum(greatest(ratio, 1e-3)) AS wc, CAST(sum(r) AS DOUBLE) AS sr, CAST(sum(c) AS DOUBLE) AS sc, CAST(sum(r * r) AS DOUBLE) AS srr, CAST(sum(c * c) AS DOUBLE) AS scc, CAST(sum(r * c) AS DOUBLE) AS src FROM wl GROUP BY ALL HAVING n >= 2),
f AS (SELECT frame, label, n, wr, wc, 0.5 * atan2(2 * (src - wr * sc - wc * sr + n * wr * wc), (scc - 2 * wc * sc + n * wc * wc) - (srr - 2 * wr * sr + n * wr * wr)) AS th FROM mo),
ev AS (SELECT frame, label, n, wr, wc, th, floor(min((r - wr) * sin(th) + (c - wc) * cos(th))) AS t0, ceil(max((r - wr) * sin(th) + (c - wc) * cos(th))) AS t1 FROM wl JOIN f USING (frame, label) GROUP BY ALL),
q AS (SELECT frame, label, n, CAST(round_even(wr + sin(th) * t0, 0) AS BIGINT) AS r0, CAST(round_even(wc + cos(th) * t0, 0) AS BIGINT) AS c0, CAST(round_even(wr + sin(th) * t1, 0) AS BIGINT) AS r1, CAST(round_even(wc + cos(th) * t1, 0) AS BIGINT) AS c1 FROM ev WHERE (t1 - t0 + 1) * 0.05::DOUBLE >= 0.45),
d AS (SELECT frame, label, n, r0, c0, r1, c1, {LINE} FROM (SELECT *, unnest(range(0, greatest(abs(r1 - r0), abs(c1 - c0)) + 1)) AS i FROM q)),
fr AS (SELECT DISTINCT l_orderkey // 64 AS frame, l_partkey % 40 AS r, l_suppkey % 128 AS c FROM lineitem),
j AS (SELECT d.*, fr.r AS fr FROM d LEFT JOIN fr USING (frame, r, c) WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 127)
SELECT frame, label, r0, c0, r1, c1, count(*) AS cells, round(n / count(*), 4) AS support, CASE WHEN count(fr) > 0 THEN 'projection_crosses_free' WHEN count(*) * 0.05 < 0.45 THEN 'projected_wall_too_short' END AS reject_reason FROM j GROUP BY frame, label, n, r0, c0, r1, c1""")
def projected_components(t: Tables):
    free = t.lineitem.selectExpr("l_orderkey div 64 as frame", "l_partkey % 40 as r", "l_suppkey % 128 as c").distinct()
    return rounded(wall_lines.projected_components(_walls(t), free, ["frame"], 40, 128))


#: Order lines as walls in six rows, with free and unknown cells between them.
GAP_SQL = """gw AS (SELECT DISTINCT l_orderkey // 64 AS frame, l_suppkey % 6 * 3 AS r, l_partkey % 480 AS c FROM lineitem),
gi AS (SELECT *, c - row_number() OVER (PARTITION BY frame, r ORDER BY c) AS i FROM gw),
gr AS (SELECT frame, r AS line, min(c) AS first, max(c) AS last, r * 1000 + min(c) AS run_id, least(1.0, count(*) / 3) AS confidence FROM gi GROUP BY frame, r, i),
gf AS (SELECT DISTINCT l_orderkey // 64 AS frame, l_linenumber * 3 - 3 AS r, l_suppkey * 11 % 480 AS c FROM lineitem UNION SELECT DISTINCT l_orderkey // 64, l_linenumber % 6 * 3, l_partkey * 3 % 480 FROM lineitem),
gu AS (SELECT DISTINCT l_orderkey // 64 AS frame, CAST(l_quantity AS BIGINT) % 6 * 3 AS r, l_partkey * 7 % 480 AS c FROM lineitem)"""


@query("facing_gaps", f"""WITH {GAP_SQL}, pr AS (SELECT a.frame, CAST(round_even((a.line + b.line) / 2, 0) AS BIGINT) AS line, a.last + 1 AS first, b.first - 1 AS last, least(a.confidence, b.confidence) AS wall_support, least(a.run_id, b.run_id) AS low, greatest(a.run_id, b.run_id) AS high
  FROM gr a JOIN gr b ON a.frame = b.frame AND b.first - a.last - 1 BETWEEN 1 AND 32 AND abs(a.line - b.line) <= 4),
sp AS (SELECT DISTINCT frame, line, first, last FROM pr), gc AS (SELECT *, unnest(range(first, last + 1)) AS c FROM sp),
ra AS (SELECT gc.frame, line, first, last, count(gf.r) / count(*) AS free_ratio, count(gu.r) / count(*) AS unknown_ratio FROM gc LEFT JOIN gf ON gf.frame = gc.frame AND gf.r = line AND gf.c = gc.c LEFT JOIN gu ON gu.frame = gc.frame AND gu.r = line AND gu.c = gc.c GROUP BY ALL)
, x AS (SELECT pr.*, free_ratio AS f, unknown_ratio AS u, wall_support AS w, (last - first + 1) * 0.05::DOUBLE AS n FROM pr JOIN ra USING (frame, line, first, last)),
k AS (SELECT *, 'physical_wall_completion' AS kind, 0.75 + 0.2::DOUBLE * w + 0.05::DOUBLE * u AS s FROM x WHERE n <= 0.45 + 0.051 AND w >= 0.35 AND (n < 0.45 OR f <= 0.8 OR u >= 0.15)
  UNION ALL SELECT *, 'missed_scan_gap_closure', 0.65 + 0.25::DOUBLE * w + 0.1::DOUBLE * (1 - f) FROM x WHERE n <= 0.45 + 0.051 AND (n < 0.45 OR f <= 0.65) AND u <= 0.7
  UNION ALL SELECT *, 'short_unknown_gap_closure', 0.55 + 0.35::DOUBLE * u + 0.1::DOUBLE * w FROM x WHERE n <= 0.6 AND u >= 0.45
  UNION ALL SELECT *, 'doorway_virtual_cut', 0.6 + 0.3::DOUBLE * f + 0.1::DOUBLE * (1 - least(1, abs(n - 1.025) / 1.025)) FROM x WHERE n BETWEEN 0.45 AND 1.6 AND w >= 0.3 AND f >= 0.55)
SELECT frame, kind, 'horizontal' AS axis, line, first, last, round(n, 4) AS length_m, CAST(floor(greatest(0, least(1, s)) * 10000 + 0.3) AS BIGINT) AS confidence_bp, round(w, 4) AS wall_support, round(f, 4) AS free_ratio, round(u, 4) AS unknown_ratio, low AS low_run, high AS high_run FROM k QUALIFY row_number() OVER (PARTITION BY frame, kind, line, first, last ORDER BY low, high) = 1""")
def facing_gaps(t: Tables):
    frame = "l_orderkey div 64 as frame"
    walls = t.lineitem.selectExpr(frame, "l_suppkey % 6 * 3 as r", "l_partkey % 480 as c").distinct()
    rows = runs.row_runs(walls, ["frame"]).selectExpr("frame", "r * 1000 + first as run_id", "'horizontal' as axis", "r as line", "first", "last", "least(1D, (last - first + 1) / 3) as confidence")
    free = t.lineitem.selectExpr(frame, "l_linenumber * 3 - 3 as r", "l_suppkey * 11 % 480 as c").union(t.lineitem.selectExpr(frame, "l_linenumber % 6 * 3", "l_partkey * 3 % 480"))
    unknown = t.lineitem.selectExpr(frame, "cast(l_quantity as long) % 6 * 3 as r", "l_partkey * 7 % 480 as c")
    got = separators.facing_gaps(rows, free, unknown, ["frame"], 40, 480)
    basis_points = F.floor(F.col("confidence") * 10000 + 0.3)  # no share of a gap lies on a border of this
    return rounded(got.withColumns({"low_run": F.col("runs.low"), "high_run": F.col("runs.high"), "confidence_bp": basis_points}).drop("runs", "confidence"))


#: Order lines as four columns of twelve cells above the bottom row 11: free, then occupied, then none; the last column is occupied to the top; some cells are free or unknown instead.
PATTERN = "case when l_linenumber = 7 and l_quantity > 49 then 'u' when l_linenumber = 6 and l_quantity > 49 then 'b' when l_suppkey % 4 = 3 then if(l_partkey % 12 < 5, 'f', 'o') when l_partkey % 12 < 3 then 'f' when l_partkey % 12 < 6 then 'o' else 'n' end"


@query("pattern_doors", """WITH pc AS (SELECT l_orderkey // 256 AS frame, l_suppkey % 4 AS c, l_partkey % 12 AS pos, CASE WHEN l_linenumber = 7 AND l_quantity > 49 THEN 'u' WHEN l_linenumber = 6 AND l_quantity > 49 THEN 'b' WHEN l_suppkey % 4 = 3 THEN CASE WHEN l_partkey % 12 < 5 THEN 'f' ELSE 'o' END WHEN l_partkey % 12 < 3 THEN 'f' WHEN l_partkey % 12 < 6 THEN 'o' ELSE 'n' END AS k FROM lineitem),
ps AS (SELECT frame, c, pos, CASE WHEN min(k) = 'b' THEN 'X' WHEN min(k) = 'f' THEN 'F' WHEN min(k) = 'o' THEN 'O' ELSE 'U' END AS s FROM pc GROUP BY ALL),
fr AS (SELECT DISTINCT frame FROM ps), grid AS (SELECT frame, c, pos, coalesce(s, 'U') AS s FROM fr CROSS JOIN range(0, 4) x(c) CROSS JOIN range(0, 12) y(pos) LEFT JOIN ps USING (frame, c, pos)),
up AS (SELECT frame, c, string_agg(s, '' ORDER BY pos) AS w FROM grid GROUP BY ALL), acr AS (SELECT frame, pos, string_agg(s, '' ORDER BY c) AS w FROM grid GROUP BY ALL),
n1 AS (SELECT *, len(regexp_extract(w, '^F*')) AS nf FROM up WHERE w LIKE 'F%'), n2 AS (SELECT *, len(regexp_extract(substr(w, nf + 1), '^O*')) AS no FROM n1), n3 AS (SELECT *, len(regexp_extract(substr(w, nf + no + 1), '^U*')) AS nu, substr(w, nf + 1, 1) AS nxt FROM n2),
tu AS (SELECT n3.*, CASE WHEN n3.c >= 3 AND len(regexp_extract(acr.w, '^O*')) >= n3.c THEN 'left' WHEN 3 - n3.c >= 3 AND len(regexp_extract(reverse(acr.w), '^O*')) >= 3 - n3.c THEN 'right' END AS turn FROM n3 JOIN acr ON acr.frame = n3.frame AND acr.pos = n3.nf - 1),
re AS (SELECT *, CASE WHEN nf < 3 THEN 'free_run_too_short' WHEN nxt = 'U' THEN 'unknown_below_occupied' WHEN no < 3 THEN 'occupied_run_too_short' WHEN nu < 1 THEN 'unknown_tail_missing' WHEN nf + no + nu < 12 THEN 'non_unknown_after_unknown_tail' END AS reason_b,
  CASE WHEN nxt = 'U' THEN 'unknown_in_lower_free_run' WHEN nf < 3 THEN 'free_run_too_short' WHEN turn IS NULL THEN 'no_valid_turn_with_all_occupied_after' END AS ra FROM tu)
SELECT frame, c, CASE WHEN reason_b IS NULL THEN 'free_occupied_unknown' WHEN ra IS NULL THEN 'free_turn_occupied' END AS rule, CASE WHEN reason_b IS NULL OR ra IS NULL THEN nf ELSE 0 END AS free_cells, CASE WHEN reason_b IS NULL THEN no WHEN ra IS NULL THEN CASE WHEN turn = 'left' THEN c ELSE 3 - c END ELSE 0 END AS occupied_cells,
  CASE WHEN reason_b IS NULL THEN nu ELSE 0 END AS unknown_cells, CASE WHEN reason_b IS NOT NULL AND ra IS NULL THEN turn END AS turn, reason_b, CASE WHEN reason_b IS NOT NULL THEN ra END AS reason_a FROM re""")
def pattern_doors(t: Tables):
    rows = t.lineitem.selectExpr("l_orderkey div 256 as frame", "11 - l_partkey % 12 as r", "l_suppkey % 4 as c", f"{PATTERN} as k").groupBy("frame", "r", "c").agg(F.min("k").alias("k"))
    cells = rows.selectExpr("frame", "r", "c", "k in ('f', 'b') as free", "k in ('o', 'b') as occupied", "k = 'u' as unknown")
    return separators.pattern_doors(cells, ["frame"], (0, 0, 11, 3))


#: Parts and suppliers of 64 order keys as a graph of twelve nodes.
EDGES_SQL = "g AS (SELECT l_orderkey // 64 AS frame, l_partkey % 12 AS a, l_suppkey % 12 AS b, min(l_quantity + l_linenumber) AS w FROM lineitem WHERE l_partkey % 12 <> l_suppkey % 12 AND l_quantity > 15 GROUP BY ALL)"


def _relaxed(rounds: int) -> str:
    """Distances after so many rounds over all edges: enough for as many nodes."""
    parts = ["d0 AS (SELECT DISTINCT frame, 0 AS node, 0.0::DOUBLE AS d FROM g)"]
    for k in range(rounds):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT frame, node, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT g.frame, g.b, d + w FROM d{k} JOIN g ON g.frame = d{k}.frame AND g.a = node) GROUP BY frame, node)")
    return ",\n".join(parts)


@query("shortest_ways", f"""WITH {EDGES_SQL}, {_relaxed(11)}, p AS (SELECT g.frame, g.b AS node, min(g.a) AS before FROM g JOIN d11 s ON s.frame = g.frame AND s.node = g.a JOIN d11 t ON t.frame = g.frame AND t.node = g.b WHERE s.d + w = t.d GROUP BY ALL)
SELECT frame, node, d AS distance, coalesce(before, -1) AS before FROM d11 LEFT JOIN p USING (frame, node)""")
def shortest_ways(t: Tables):
    edges = t.lineitem.where("l_partkey % 12 <> l_suppkey % 12 and l_quantity > 15").selectExpr("l_orderkey div 64 as frame", "l_partkey % 12 as a", "l_suppkey % 12 as b", "l_quantity + l_linenumber as weight")
    sources = edges.selectExpr("frame", "0L as node").distinct()
    return routes.shortest_ways(edges, sources, ["frame"]).withColumn("before", F.coalesce("before", F.lit(-1)))


#: Events as what an agent knows at a step of 20 events: it stands at the first one; views are frontier cells, clicks entries of rooms, others waypoints of doors.
@query("next_targets", """WITH m AS (SELECT event_id // 20 AS step, event_id, user_id % 40 AS r, (event_id * 7919) % 64 AS c, event_type, value FROM events),
a AS (SELECT step, r AS ar, c AS ac, event_type = 'purchase' AS esc FROM m WHERE event_id % 20 = 0),
fc AS (SELECT m.step, r // 20 AS k, count(*) AS size, min(sqrt((r - ar) ^ 2 + (c - ac) ^ 2)) AS d, min(r * 64 + c) AS rc FROM m JOIN a USING (step) WHERE event_type = 'view' AND event_id % 20 < 4 GROUP BY ALL),
f AS (SELECT step, rc // 64 AS fr, rc % 64 AS fcol FROM fc QUALIFY row_number() OVER (PARTITION BY step ORDER BY size DESC, round(d, 6), rc // 64, rc % 64) = 1),
n AS (SELECT m.step, r AS nr, c AS nc FROM m JOIN a USING (step) WHERE event_type = 'click' AND value > 10 QUALIFY row_number() OVER (PARTITION BY m.step ORDER BY round(sqrt((r - ar) ^ 2 + (c - ac) ^ 2), 6), event_id, r, c) = 1),
w AS (SELECT m.step, r AS wr, c AS wc FROM m JOIN a USING (step) WHERE event_type NOT IN ('view', 'click') AND esc QUALIFY row_number() OVER (PARTITION BY m.step ORDER BY round(sqrt((r - ar) ^ 2 + (c - ac) ^ 2), 6), r, c) = 1)
SELECT step, coalesce(CASE WHEN esc THEN wr ELSE coalesce(fr, nr) END, -1) AS target_r, coalesce(CASE WHEN esc THEN wc ELSE coalesce(fcol, nc) END, -1) AS target_c, CASE WHEN esc THEN 'escape' WHEN fr IS NOT NULL THEN 'current_room_frontier' WHEN nr IS NOT NULL THEN 'nearest_unexplored' ELSE 'done' END AS reason,
  CASE WHEN esc THEN wr ELSE coalesce(fr, nr) END IS NULL AS done FROM a LEFT JOIN f USING (step) LEFT JOIN n USING (step) LEFT JOIN w USING (step)""")
def next_targets(t: Tables):
    m = t.events.selectExpr("event_id div 20 as step", "event_id", "user_id % 40 as r", "(event_id * 7919) % 64 as c", "event_type", "value")
    agents = m.where("event_id % 20 = 0").selectExpr("step", "r", "c", "event_type = 'purchase' as escaped")
    seen = m.where("event_type = 'view' and event_id % 20 < 4").join(agents.selectExpr("step", "r as ar", "c as ac"), "step")
    frontiers = seen.groupBy("step", F.expr("r div 20")).agg(F.count("*").alias("size"), F.round(F.min(F.hypot(F.col("r") - F.col("ar"), F.col("c") - F.col("ac"))), 6).alias("distance"), F.min(F.struct("r", "c")).alias("x")).select("step", "size", "distance", "x.r", "x.c")
    nodes = m.where("event_type = 'click'").selectExpr("step", "event_id as node_id", "if(value > 10, 'Unexplored', 'Explored') as status", "r", "c")
    got = routes.next_targets(agents, frontiers, nodes, m.where("event_type not in ('view', 'click')").select("step", "r", "c"), ["step"])
    return got.withColumns({x: F.coalesce(x, F.lit(-1)) for x in ("target_r", "target_c")})


def _ground(t: Tables):
    """Events but errors and purchases, 500 a map, widened to ground."""
    cells = t.events.where("event_type not in ('error', 'purchase')").selectExpr("event_id div 500 as frame", "cast(user_id % 40 as int) as r", "cast((event_id * 7919) % 64 as int) as c")
    return raster.dilate(cells, ["frame"], raster.disk(1), H, W)


@query("thinned_ground")
def thinned_ground(t: Tables):
    return cuts.thinned(_ground(t), ["frame"])


@query("cut_verdicts")
def cut_verdicts(t: Tables):
    lines = t.events.where("event_type in ('error', 'purchase')").selectExpr("event_id div 500 as frame", "event_id as cut_id", "explode(sequence(cast(user_id % 40 as int) - 3, cast(user_id % 40 as int) + 3)) as r", "cast((event_id * 7919) % 64 as int) as c")
    unknown = raster.complement(_ground(t), t.events.selectExpr("event_id div 500 as frame"), ["frame"], H, W).where("(r + c) % 3 = 0")
    return cuts.cut_verdicts(cuts.sides_of_cuts(_ground(t), unknown, lines, ["frame"], H, W), ["frame"])


@query("voxel_rooms")
def voxel_rooms(t: Tables):
    """Orders as the columns of flats of 20 by 64 cells: two rooms behind a wall of three columns with a door of nine rows, a hatch or an open passage by turns; a row a voxel."""
    at = t.orders.selectExpr("o_orderkey div 1280 as frame", "cast(o_orderkey % 1280 div 64 as int) as r", "cast(o_orderkey % 64 as int) as c")
    kind = """case when r in (0, 19) or c in (0, 63) then 'wall' when c not between 30 and 32 then 'ground'
              when r between 3 + frame % 4 and 11 + frame % 4 then case frame % 3 when 0 then 'door' when 1 then 'low' else 'ground' end else 'wall' end"""
    spans = """case kind when 'wall' then array(named_struct('a', 1, 'b', 49, 's', 2)) when 'ground' then array(named_struct('a', 1, 'b', 45, 's', 1))
               when 'door' then array(named_struct('a', 1, 'b', 35, 's', 1), named_struct('a', 36, 'b', 49, 's', 2)) else array(named_struct('a', 1, 'b', 12, 's', 1), named_struct('a', 13, 'b', 49, 's', 2)) end"""
    known = at.selectExpr("*", f"{kind} as kind").selectExpr("frame", "r", "c", f"explode({spans}) as x").selectExpr("frame", "explode(sequence(x.a, x.b)) as z", "r", "c", "x.s as state", "1 as seen")
    rules = rooms.RoomRules(layers=50, seeds=voxels.DoorSeedRules(turn_min_m=1.0), least_room=20)
    return rooms.voxel_rooms(known, ["frame"], 20, 64, rules)["rooms"]
