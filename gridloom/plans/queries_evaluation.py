"""Queries over label maps, results, matches and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import doors, frontier, graph, labels, matching
from ..sources import sinks
from .registry import Tables, query

KEYS = ["scene"]
TABLE = "ct AS (SELECT coalesce(g.scene, p.scene) AS scene, coalesce(g.label, 0) AS gt, coalesce(p.label, 0) AS pred, count(*) AS cells FROM gt g FULL OUTER JOIN pred p ON g.scene = p.scene AND g.r = p.r AND g.c = p.c GROUP BY ALL)"
IOU = f"{TABLE}, ag AS (SELECT scene, gt, sum(cells) AS a FROM ct WHERE gt > 0 GROUP BY ALL), ap AS (SELECT scene, pred, sum(cells) AS b FROM ct WHERE pred > 0 GROUP BY ALL)"


@query("label_contingency", f"WITH {TABLE} SELECT * FROM ct")
def label_contingency(t: Tables):
    return labels.contingency(t.gt, t.pred, KEYS)


@query("iou_matrix", f"WITH {IOU} SELECT scene, gt, pred, round(cells / (a + b - cells), 6) AS iou FROM ct JOIN ag USING (scene, gt) JOIN ap USING (scene, pred)")
def iou_matrix(t: Tables):
    return labels.ious(labels.contingency(t.gt, t.pred, KEYS), KEYS)


@query("usr_osr", f"WITH {TABLE}, n AS (SELECT scene, count(DISTINCT CASE WHEN gt > 0 THEN gt END) AS n_gt, count(DISTINCT CASE WHEN pred > 0 THEN pred END) AS n_pred FROM ct GROUP BY ALL) SELECT *, round(greatest(n_gt - n_pred, 0) / greatest(n_gt, 1), 6) AS usr, round(greatest(n_pred - n_gt, 0) / greatest(n_gt, 1), 6) AS osr FROM n")
def usr_osr(t: Tables):
    n = labels.contingency(t.gt, t.pred, KEYS).groupBy("scene").agg(F.count_distinct(F.when(F.col("gt") > 0, F.col("gt"))).alias("n_gt"), F.count_distinct(F.when(F.col("pred") > 0, F.col("pred"))).alias("n_pred"))
    return n.withColumn("usr", scalar.under_segmentation(F.col("n_gt"), F.col("n_pred"))).withColumn("osr", scalar.over_segmentation(F.col("n_gt"), F.col("n_pred")))


@query("dense_relabel", "SELECT scene, r, c, dense_rank() OVER (PARTITION BY scene ORDER BY label) AS label FROM pred WHERE label % 2 = 0")
def dense_relabel(t: Tables):
    return labels.relabelled(t.pred.where("label % 2 = 0"), KEYS)


@query("relabel_in_order", "SELECT scene, r, c, CAST(CASE label WHEN 7 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS label FROM gt WHERE label IN (7, 2, 5)")
def relabel_in_order(t: Tables):
    return labels.relabelled_as(t.gt, KEYS, [7, 2, 5])


@query("small_label_filter", "SELECT scene, r, c, dense_rank() OVER (PARTITION BY scene ORDER BY label) AS label FROM (SELECT *, count(*) OVER (PARTITION BY scene, label) AS n FROM gt) WHERE n >= 8")
def small_label_filter(t: Tables):
    return labels.without_small(t.gt, KEYS, 8)


@query("merge_groups", "SELECT scene, r, c, dense_rank() OVER (PARTITION BY scene ORDER BY m) AS label FROM (SELECT *, CASE WHEN label IN (2, 5, 9) THEN 2 WHEN label IN (3, 4) THEN 3 ELSE label END AS m FROM gt)")
def merge_groups(t: Tables):
    groups = t.spark.createDataFrame([(1, 2), (1, 5), (1, 9), (2, 3), (2, 4)], "group_id int, label int")
    return labels.merged(t.gt, groups, KEYS)


@query("clip_to_domain", "SELECT p.scene, p.r, p.c, dense_rank() OVER (PARTITION BY p.scene ORDER BY p.label) AS label FROM pred p JOIN gt g USING (scene, r, c) WHERE g.label > 4")
def clip_to_domain(t: Tables):
    return labels.clipped_to(t.pred, t.gt.where("label > 4"), KEYS)


@query("label_adjacency", "WITH p AS (SELECT a.scene, a.label AS x, b.label AS y FROM gt a JOIN gt b ON a.scene = b.scene AND ((b.r = a.r + 1 AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + 1)) WHERE a.label <> b.label) SELECT scene, least(x, y) AS a, greatest(x, y) AS b, count(*) AS border FROM p GROUP BY ALL")
def label_adjacency(t: Tables):
    return labels.adjacency(t.gt, KEYS)


@query("label_perimeters", "WITH s AS (SELECT a.scene, a.label, b.label AS other FROM gt a CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc) LEFT JOIN gt b ON b.scene = a.scene AND b.r = a.r + dr AND b.c = a.c + dc) SELECT scene, label, count(*) AS perimeter FROM s WHERE other IS NULL OR other <> label GROUP BY ALL")
def label_perimeters(t: Tables):
    return labels.perimeters(t.gt, KEYS)


#: Labels of both maps run from 1 to 10.
MOST_LABELS = 10


def _assigned(rows: str) -> str:
    """The largest total IoU of one-to-one pairs: truth label by truth label, the best total by the set of found labels used."""
    first = "d0 AS (SELECT DISTINCT scene, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS total FROM ct)"
    more = [
        f"d{k} AS (SELECT scene, used, max(total) AS total FROM (SELECT scene, used, total FROM d{k - 1} UNION ALL SELECT d.scene, d.used | (CAST(1 AS BIGINT) << pred), d.total + iou FROM d{k - 1} d JOIN iou USING (scene) WHERE gt = {k} AND (d.used >> pred) & 1 = 0) GROUP BY ALL)"
        for k in range(1, MOST_LABELS + 1)
    ]
    return ", ".join([rows, first, *more, f"best AS (SELECT scene, max(total) AS total FROM d{MOST_LABELS} GROUP BY scene)"])


PLAIN = f"{IOU}, iou AS (SELECT scene, gt, pred, cells / (a + b - cells) AS iou FROM ct JOIN ag USING (scene, gt) JOIN ap USING (scene, pred)), n AS (SELECT scene, count(DISTINCT CASE WHEN gt > 0 THEN gt END) AS n_gt, count(DISTINCT CASE WHEN pred > 0 THEN pred END) AS n_pred FROM ct GROUP BY ALL)"
FILTERED = f"""{TABLE}, g1 AS (SELECT scene, gt FROM ct WHERE gt > 0 GROUP BY ALL HAVING sum(cells) >= 2), p1 AS (SELECT scene, pred FROM ct WHERE gt > 0 AND pred > 0 GROUP BY ALL HAVING sum(cells) >= 2),
c2 AS (SELECT ct.* FROM ct JOIN g1 USING (scene, gt)), p2 AS (SELECT scene, pred FROM c2 JOIN p1 USING (scene, pred) GROUP BY ALL HAVING sum(cells) >= 2),
ag AS (SELECT scene, gt, sum(cells) AS a FROM c2 GROUP BY ALL), ap AS (SELECT scene, pred, sum(cells) AS b FROM c2 JOIN p2 USING (scene, pred) GROUP BY ALL),
iou AS (SELECT scene, gt, pred, cells / (a + b - cells) AS iou FROM c2 JOIN ag USING (scene, gt) JOIN ap USING (scene, pred)),
n AS (SELECT s.scene, (SELECT count(*) FROM g1 WHERE g1.scene = s.scene) AS n_gt, (SELECT count(*) FROM p2 WHERE p2.scene = s.scene) AS n_pred FROM (SELECT DISTINCT scene FROM ct) s)"""


@query("matched_miou", f"WITH {_assigned(PLAIN)} SELECT scene, n_gt, n_pred, round(total / greatest(n_gt, 1), 6) AS miou FROM n JOIN best USING (scene)")
def matched_miou(t: Tables):
    return labels.matched(labels.contingency(t.gt, t.pred, KEYS), KEYS).drop("pairs")


@query("snapshot_metrics", f"WITH {_assigned(FILTERED)} SELECT scene, n_gt, n_pred, round(total / greatest(n_gt, 1), 6) AS miou, round(greatest(n_gt - n_pred, 0) / greatest(n_gt, 1), 6) AS usr, round(greatest(n_pred - n_gt, 0) / greatest(n_gt, 1), 6) AS osr FROM n JOIN best USING (scene)")
def snapshot_metrics(t: Tables):
    return labels.snapshot_metrics(t.gt, t.pred, KEYS, 2).drop("pairs")


@query("backproject_truth", "SELECT scene, r, c, dense_rank() OVER (PARTITION BY scene ORDER BY label) AS label FROM (SELECT g.scene, g.r, g.c, g.label, count(*) OVER (PARTITION BY g.scene, g.label) AS n FROM gt g JOIN pred p USING (scene, r, c) WHERE p.label % 2 = 0) WHERE n >= 4")
def backproject_truth(t: Tables):
    return labels.backprojected(t.gt, t.pred.where("label % 2 = 0"), KEYS, 4)


@query("metric_domain", "WITH k AS (SELECT event_id % 11 AS scene, event_id AS r, 0 AS c, (event_id % 11 > 4 AND event_id % 3 = 0) AS nav, event_id % 2 = 0 AS free, event_type = 'error' AS obstacle FROM events), f AS (SELECT *, max(CAST(nav AS INT)) OVER (PARTITION BY scene) AS has FROM k) SELECT scene, r, CAST(c AS BIGINT) AS c FROM f WHERE (CASE WHEN has = 1 THEN nav ELSE free END) AND NOT obstacle")
def metric_domain(t: Tables):
    cells = t.events.selectExpr("event_id % 11 as scene", "event_id as r", "0 as c", "event_id % 11 > 4 and event_id % 3 = 0 as nav_free_domain", "event_id % 2 = 0 as observed_free", "event_type = 'error' as obstacle", "false as unknown")
    return labels.metric_domain(cells, KEYS)


def _results(t: Tables):
    return t.orders.selectExpr("o_custkey % 7 as planner", "o_orderpriority as detector", "o_orderstatus <> 'P' as metric_valid", "o_orderstatus = 'F' as success", "o_totalprice / 1000 as path_length", "o_custkey / 3.0D as shortest", "o_totalprice % 10 as distance_to_goal", "filter(array(if(o_custkey % 2 = 0, 'a', null), if(o_custkey % 3 = 0, 'b', null)), x -> x is not null) as fallbacks_used", "o_orderkey").withColumns({
        "spl": scalar.spl(F.col("success"), F.col("shortest"), F.col("path_length")), "softspl": scalar.soft_spl(F.lit(12.0), F.col("distance_to_goal"), F.col("shortest"), F.col("path_length")),
    })


RESULTS = """res AS (SELECT o_custkey % 7 AS planner, o_orderpriority AS detector, o_orderstatus <> 'P' AS metric_valid, o_orderstatus = 'F' AS success, o_totalprice / 1000 AS path_length, o_custkey / 3.0 AS shortest, o_totalprice % 10 AS distance_to_goal, o_custkey, o_orderkey FROM orders),
scored AS (SELECT *, CASE WHEN success THEN CAST(shortest AS DOUBLE) / greatest(path_length, shortest, 1e-6) ELSE 0 END AS spl, greatest(0.0, 1 - distance_to_goal / 12.0) * shortest / greatest(path_length, shortest, 1e-6) AS softspl FROM res)"""


@query("spl_softspl", f"WITH {RESULTS} SELECT o_orderkey, round(spl, 6) AS spl, round(softspl, 6) AS softspl FROM scored")
def spl_softspl(t: Tables):
    return _results(t).select("o_orderkey", "spl", "softspl")


@query("summary_by_key", f"WITH {RESULTS} SELECT planner, detector, count(*) AS episodes, count(*) FILTER (metric_valid) AS metric_valid_episodes, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS sr, round(avg(spl), 6) AS spl, round(avg(softspl), 6) AS softspl, round(avg(path_length), 6) AS mean_path_length FROM scored GROUP BY ALL")
def summary_by_key(t: Tables):
    return labels.summary(_results(t), ["planner", "detector"]).select("planner", "detector", "episodes", "metric_valid_episodes", "sr", "spl", "softspl", "mean_path_length")


@query("fallback_histogram", f"WITH {RESULTS} SELECT planner, 'a' AS fallback, count(*) AS n FROM scored WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT planner, 'b', count(*) FROM scored WHERE o_custkey % 3 = 0 GROUP BY 1")
def fallback_histogram(t: Tables):
    return labels.summary(_results(t), ["planner"]).select("planner", F.explode("fallback_counts").alias("fallback", "n"))


@query("mean_and_deviation", f"WITH {RESULTS} SELECT planner, round(avg(path_length), 6) AS path_length_mean, round(stddev_pop(path_length), 6) AS path_length_std FROM scored GROUP BY 1")
def mean_and_deviation(t: Tables):
    return labels.mean_and_deviation(_results(t), ["planner"], ["path_length"])


@query("episode_first_mean", "WITH v AS (SELECT user_id AS episode, value AS miou FROM events WHERE event_type <> 'error'), m AS (SELECT episode, avg(miou) AS miou FROM v GROUP BY 1) SELECT count(*) AS episodes, round(avg(miou), 6) AS miou, (SELECT count(*) FROM v) AS snapshots, (SELECT round(avg(miou), 6) FROM v) AS pooled_miou FROM m")
def episode_first_mean(t: Tables):
    rows = t.events.selectExpr("user_id as episode", "value as miou", "event_type <> 'error' as valid")
    return labels.episode_first(rows, ["episode"], ["miou"])[1]


@query("path_length", "WITH p AS (SELECT user_id, event_id, value / 1000 AS x, (event_id % 10) / 20.0 AS y FROM events), d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(sum(CASE WHEN d < 0.5 THEN d ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS path_m FROM d")
def path_length(t: Tables):
    points = t.events.selectExpr("user_id", "event_id", "value / 1000 as x", "(event_id % 10) / 20.0D as y")
    return labels.path_length(points, ["user_id"], "event_id").select("user_id", "event_id", "path_m")


@query("score_normalise", "SELECT p_partkey, round(coalesce((p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 0), 6) AS minmax FROM part")
def score_normalise(t: Tables):
    return labels.score_normalised(t.part.select("p_partkey", "p_retailprice", F.lit(1).alias("one")), "p_retailprice", "minmax", ["one"]).select("p_partkey", F.col("score").alias("minmax"))


@query("score_zscore", "SELECT p_partkey, round(coalesce((p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_pop(p_retailprice) OVER w, 0), 0), 6) AS zscore FROM part WINDOW w AS (PARTITION BY p_partkey % 10)")
def score_zscore(t: Tables):
    return labels.score_normalised(t.part.selectExpr("p_partkey", "p_retailprice", "p_partkey % 10 as k"), "p_retailprice", "zscore", ["k"]).select("p_partkey", F.col("score").alias("zscore"))


@query("weighted_median", "WITH w AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS s, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) SELECT l_suppkey, round(min(v), 6) AS median FROM w WHERE s >= total / 2 GROUP BY 1")
def weighted_median(t: Tables):
    return labels.weighted_median(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("method_gaps", "WITH x AS (SELECT DISTINCT user_id % 3 AS method, event_id // 5 AS step FROM events WHERE value > 20) SELECT m.method, s.step FROM (SELECT DISTINCT method FROM x) m, (SELECT DISTINCT step FROM x) s EXCEPT SELECT method, step FROM x")
def method_gaps(t: Tables):
    return labels.same_snapshots(t.events.where("value > 20").selectExpr("user_id % 3 as method", "event_id div 5 as step"), "method", ["step"])


@query("last_snapshot_asof", "WITH s AS (SELECT o_custkey, o_orderkey AS step FROM orders), f AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 9 END AS final FROM customer), j AS (SELECT s.*, final, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN final IS NULL OR step <= final THEN 0 ELSE 1 END, CASE WHEN final IS NULL OR step <= final THEN -step ELSE step END) AS n FROM s LEFT JOIN f USING (o_custkey)) SELECT o_custkey, step, CASE WHEN final IS NULL THEN 'snapshot_only' WHEN step = final THEN 'exact' WHEN step < final THEN 'within_final' ELSE 'nearest_after_final' END AS status FROM j WHERE n = 1")
def last_snapshot_asof(t: Tables):
    reported = t.customer.selectExpr("c_custkey as o_custkey", "if(c_custkey % 3 > 0, c_custkey * 9, null) as final_step")
    return matching.last_snapshot(t.orders.selectExpr("o_custkey", "o_orderkey as step"), reported, ["o_custkey"])


@query("link_join", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def link_join(t: Tables):
    method = t.lineitem.selectExpr("l_orderkey", "l_linenumber")
    return matching.linked(method, t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey as l_orderkey", "o_custkey"), ["l_orderkey"])[0]


@query("link_missing", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def link_missing(t: Tables):
    method = t.lineitem.selectExpr("l_orderkey", "l_linenumber")
    return matching.linked(method, t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey as l_orderkey", "o_custkey"), ["l_orderkey"])[1]


POINTS = "SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y FROM supplier"


def _points(t: Tables, ident: str = "point_id"):
    return t.supplier.selectExpr(f"s_suppkey as {ident}", "cast(s_suppkey * 37 % 101 as double) as x", "cast(s_suppkey * 53 % 97 as double) as y")


@query("nearest_match", f"WITH p AS ({POINTS}), q AS (SELECT c_custkey AS qid, CAST(c_custkey * 29 % 101 AS DOUBLE) AS qx, CAST(c_custkey * 31 % 97 AS DOUBLE) AS qy FROM customer), m AS (SELECT qid, id, sqrt(pow(x - qx, 2) + pow(y - qy, 2)) AS d FROM q, p WHERE sqrt(pow(x - qx, 2) + pow(y - qy, 2)) < 4) SELECT qid AS query_id, id AS point_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM m) WHERE n = 1")
def nearest_match(t: Tables):
    queries = t.customer.selectExpr("c_custkey as query_id", "cast(c_custkey * 29 % 101 as double) as x", "cast(c_custkey * 31 % 97 as double) as y")
    return matching.nearest(queries, _points(t), 4.0)


@query("pairs_within", f"WITH p AS ({POINTS}) SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a, p b WHERE a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 5")
def pairs_within(t: Tables):
    return matching.pairs_within(_points(t), 5.0)


@query("epsilon_groups", f"WITH p AS (SELECT *, id % 3 AS room FROM ({POINTS})), link AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.room = b.room AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 6), reached(x, y) AS (SELECT id, id FROM p UNION SELECT q.x, l.y FROM reached q JOIN link l ON q.y = l.x), g AS (SELECT x AS id, min(y) AS group_id FROM reached GROUP BY 1) SELECT room, id AS point_id, group_id, round(avg(x) OVER (PARTITION BY room, group_id), 6) AS centre_x, count(*) OVER (PARTITION BY room, group_id) AS members FROM p JOIN g USING (id)", recursive=True)
def epsilon_groups(t: Tables):
    points = _points(t).withColumn("room", F.col("point_id") % 3)
    return matching.epsilon_groups(points, 6.0, ["room"]).select("room", "point_id", "group_id", "centre_x", "members")


@query("room_of_points", f"WITH p AS ({POINTS}) SELECT id AS point_id, CASE WHEN x < 100 AND y < 100 THEN CAST(floor(y / 20) * 5 + floor(x / 20) AS BIGINT) ELSE -1 END AS polygon_id FROM p")
def room_of_points(t: Tables):
    polygons = t.nation.selectExpr("1 as frame", "n_nationkey as polygon_id", "cast(n_nationkey % 5 * 20 as double) as x", "cast(n_nationkey div 5 * 20 as double) as y").selectExpr("frame", "polygon_id", "array(named_struct('x', x, 'y', y), named_struct('x', x + 20, 'y', y), named_struct('x', x + 20, 'y', y + 20), named_struct('x', x, 'y', y + 20)) as points")
    return matching.room_of_points(_points(t).withColumn("frame", F.lit(1)), polygons, ["frame"]).select("point_id", "polygon_id").fillna(-1, ["polygon_id"])


@query("rooms_of_objects", "WITH o AS (SELECT vec_id // 250 AS scene, vec_id // 25 AS r, vec_id % 25 AS c, vec_id % 23 AS object_id FROM embeddings), v AS (SELECT o.scene, object_id, label, count(*) AS n FROM o JOIN gt USING (scene, r, c) GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS rank, lead(n) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY scene, object_id ORDER BY n DESC, label)), s AS (SELECT scene, object_id, count(*) AS cells FROM o GROUP BY ALL) SELECT s.scene, s.object_id, label, round(coalesce(n / cells, 0), 6) AS share, coalesce((n - coalesce(nxt, 0)) / cells < 0.1, false) AS ambiguous FROM s LEFT JOIN k ON k.scene = s.scene AND k.object_id = s.object_id AND rank = 1")
def rooms_of_objects(t: Tables):
    objects = t.embeddings.selectExpr("vec_id div 250 as scene", "vec_id div 25 as r", "vec_id % 25 as c", "vec_id % 23 as object_id")
    return matching.rooms_of_objects(objects, t.gt, KEYS)


@query("ttl_suppress", "WITH f AS (SELECT event_id AS frontier_id, step, CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y FROM e), m AS (SELECT step, CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y, step + 3 AS until FROM e WHERE event_id % 200 = 0) SELECT frontier_id, step FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.step <= f.step AND f.step <= m.until AND sqrt(pow(m.x - f.x, 2) + pow(m.y - f.y, 2)) <= 2)")
def ttl_suppress(t: Tables):
    rows = t.e.selectExpr("1 as one", "event_id as frontier_id", "step", "cast(r as double) as x", "cast(c as double) as y")
    records = t.e.where("event_id % 200 = 0").selectExpr("1 as one", "event_id as record_id", "step", "cast(r as double) as x", "cast(c as double) as y", "step + 3 as until_step")
    return matching.suppressed(rows, records, ["one"], 2.0).select("frontier_id", "step")


@query("frontier_score", "WITH f AS (SELECT frame, event_id AS frontier_id, r AS y, c AS x FROM e WHERE event_type = 'view'), s AS (SELECT frame, event_id AS sid, r AS y, c AS x, value / 500 AS p FROM e WHERE event_type = 'purchase') SELECT f.frame, frontier_id, round(sum(p / greatest(sqrt(pow(f.x - s.x, 2) + pow(f.y - s.y, 2)), 0.000001)), 6) AS score FROM f JOIN s USING (frame) GROUP BY ALL")
def frontier_score(t: Tables):
    f = t.e.where("event_type = 'view'").selectExpr("frame", "event_id as frontier_id", "r as y", "c as x")
    s = t.e.where("event_type = 'purchase'").selectExpr("frame", "event_id as subgraph_id", "r as y", "c as x", "value / 500 as p")
    return matching.frontier_scores(f, s, ["frame"]).select("frame", "frontier_id", "score")


@query("frontier_top_terms", "WITH f AS (SELECT frame, event_id AS frontier_id, r AS y, c AS x FROM e WHERE event_type = 'view'), s AS (SELECT frame, event_id AS sid, r AS y, c AS x, value / 500 AS p FROM e WHERE event_type = 'purchase'), m AS (SELECT f.frame, frontier_id, sid, p / greatest(sqrt(pow(f.x - s.x, 2) + pow(f.y - s.y, 2)), 0.000001) AS term FROM f JOIN s USING (frame)) SELECT frame, frontier_id, rank, sid AS subgraph_id, round(term, 6) AS term FROM (SELECT *, row_number() OVER (PARTITION BY frame, frontier_id ORDER BY term DESC, sid) AS rank FROM m) WHERE rank <= 3")
def frontier_top_terms(t: Tables):
    f = t.e.where("event_type = 'view'").selectExpr("frame", "event_id as frontier_id", "r as y", "c as x")
    s = t.e.where("event_type = 'purchase'").selectExpr("frame", "event_id as subgraph_id", "r as y", "c as x", "value / 500 as p")
    return matching.frontier_scores(f, s, ["frame"]).select("frame", "frontier_id", F.explode("contributors").alias("k")).select("frame", "frontier_id", "k.rank", "k.subgraph_id", "k.term")


LINE = "n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM p), k AS (SELECT *, CAST(round_even(r0 + (r1 - r0) * i / CAST(greatest(n, 1) AS DOUBLE), 0) AS BIGINT) AS r, CAST(round_even(c0 + (c1 - c0) * i / CAST(greatest(n, 1) AS DOUBLE), 0) AS BIGINT) AS c FROM (SELECT *, unnest(range(n + 1)) AS i FROM n))"


@query("door_pairs", f"WITH p AS (SELECT x.frame, x.r * 64 + x.c AS a, y.r * 64 + y.c AS b, x.r AS r0, x.c AS c0, y.r AS r1, y.c AS c1, sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) AS d FROM occupied x JOIN occupied y ON x.frame = y.frame AND x.r * 64 + x.c < y.r * 64 + y.c WHERE sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) BETWEEN 2 AND 5), {LINE} SELECT k.frame, a, b, round(d, 6) AS width, round(count(cells.r) / count(*), 6) AS ratio FROM k LEFT JOIN cells ON cells.frame = k.frame AND cells.r = k.r AND cells.c = k.c GROUP BY k.frame, a, b, d HAVING count(cells.r) / count(*) >= 0.45")
def door_pairs(t: Tables):
    points = t.occupied.selectExpr("frame", "r * 64 + c as point_id", "cast(c as double) as x", "cast(r as double) as y")
    return matching.door_pairs(points, t.cells, ["frame"], 2.0, 5.0)


@query("spaced_points", """WITH o AS (SELECT frame, event_id AS point_id, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, value AS score, row_number() OVER (PARTITION BY frame ORDER BY value DESC, event_id) AS n FROM e),
f(frame, n, kept) AS (SELECT DISTINCT frame, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[]) FROM o UNION ALL
SELECT f.frame, o.n, CASE WHEN len(list_filter(f.kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 16)) > 0 THEN f.kept ELSE list_append(f.kept, {'i': o.point_id, 'x': o.x, 'y': o.y}) END FROM f JOIN o ON o.frame = f.frame AND o.n = f.n + 1),
ids AS (SELECT frame, unnest(list_transform(arg_max(kept, n), lambda k: k.i)) AS point_id FROM f GROUP BY frame)
SELECT frame, point_id, x, y, round(score, 6) AS score FROM o JOIN ids USING (frame, point_id)""", recursive=True)
def spaced_points(t: Tables):
    return matching.spaced(t.e.selectExpr("frame", "event_id as point_id", "cast(c as double) as x", "cast(r as double) as y", "value as score"), ["frame"], 4.0)


@query("random_frontier")
def random_frontier(t: Tables):
    return frontier.random_choice(t.cells.withColumn("label", F.col("r") * 64 + F.col("c")), ["frame"], 7)


@query("sample_cells", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY frame) AS total FROM cells) SELECT frame, r, c FROM n WHERE k % greatest(1, CAST(ceil(total / 100) AS BIGINT)) = 0")
def sample_cells(t: Tables):
    return frontier.sampled_cells(t.cells, ["frame"], 100)


@query("room_context", "WITH m AS (SELECT DISTINCT vec_id // 250 AS scene, vec_id % 19 AS frontier_id, vec_id // 25 AS r, vec_id % 25 AS c FROM embeddings), d AS (SELECT DISTINCT scene, frontier_id, r + dr AS r, c + dc AS c FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)), v AS (SELECT scene, frontier_id, label, count(*) AS n FROM d JOIN gt USING (scene, r, c) GROUP BY ALL), k AS (SELECT *, n / sum(n) OVER (PARTITION BY scene, frontier_id) AS ratio, row_number() OVER (PARTITION BY scene, frontier_id ORDER BY n DESC, label) AS rank FROM v) SELECT scene, frontier_id, label, round(ratio, 6) AS ratio FROM k WHERE rank = 1 AND ratio >= 0.2")
def room_context(t: Tables):
    members = t.embeddings.selectExpr("vec_id div 250 as scene", "vec_id % 19 as frontier_id", "vec_id div 25 as r", "vec_id % 25 as c").distinct()
    return frontier.room_context(members, t.gt, KEYS, 1)


@query("update_gate", "SELECT event_id, CASE WHEN event_type = 'error' THEN true WHEN value > 100 THEN false WHEN user_id % 5 = 0 THEN true ELSE false END AS \"update\", CASE WHEN event_type = 'error' THEN 'forced' WHEN value > 100 THEN 'cooldown' WHEN user_id % 5 = 0 THEN 'no_path' ELSE 'cached' END AS reason FROM events")
def update_gate(t: Tables):
    gate = frontier.update_gate(forced=F.col("event_type") == "error", cooldown=F.col("value") > 100, no_path=F.col("user_id") % 5 == 0)
    return t.events.select("event_id", gate.alias("g")).select("event_id", "g.update", "g.reason")


def _objects(t: Tables):
    return t.part.selectExpr("p_partkey % 4 as frame", "p_partkey as object_id", "if(p_partkey % 5 = 0, null, p_partkey % 3) as room_id", "p_size / 50.0D as confidence")


@query("affiliation_edges", "WITH o AS (SELECT p_partkey % 4 AS frame, p_partkey AS object_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 END AS room_id, p_size / 50.0 AS confidence FROM part) SELECT frame, object_id AS source, room_id, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM o WHERE room_id IS NOT NULL UNION ALL SELECT frame, 1000000 + object_id // 6, min(room_id), round(avg(CAST(confidence AS DOUBLE)), 6) FROM o GROUP BY frame, 1000000 + object_id // 6 HAVING count(DISTINCT room_id) = 1 AND count(*) = count(room_id)")
def affiliation_edges(t: Tables):
    groups = t.part.selectExpr("p_partkey % 4 as frame", "1000000 + p_partkey div 6 as group_id", "p_partkey as object_id")
    return graph.affiliation(_objects(t), groups, ["frame"])


@query("object_subgraphs", "WITH o AS (SELECT p_partkey % 4 AS frame, p_partkey AS id FROM part), x AS (SELECT frame, id AS a, id + 4 AS b FROM o WHERE id % 3 = 0), m AS (SELECT frame, id AS center, id AS member FROM o UNION SELECT frame, a, b FROM x UNION SELECT x.frame, b, a FROM x JOIN o ON o.id = x.b) SELECT frame, center, count(*) AS members FROM m JOIN o USING (frame) WHERE o.id = center GROUP BY ALL")
def object_subgraphs(t: Tables):
    nodes = t.part.selectExpr("p_partkey % 4 as frame", "p_partkey as node_id", "'object' as kind", "cast(null as long) as room_id", "cast(null as long) as group_id")
    edges = t.part.where("p_partkey % 3 = 0").selectExpr("p_partkey % 4 as frame", "p_partkey as a", "p_partkey + 4 as b")
    return graph.subgraphs(nodes, edges, ["frame"]).select("frame", "center", F.size("members").alias("members"))


@query("label_distribution", "WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE value > 0 GROUP BY ALL), p AS (SELECT *, v / sum(v) OVER (PARTITION BY user_id) AS q FROM s) SELECT user_id, round(sum(-q * ln(q)), 6) AS entropy, arg_max(event_type, v) AS category FROM p GROUP BY 1")
def label_distribution(t: Tables):
    rows = t.events.where("value > 0").selectExpr("user_id", "event_type as category", "value as confidence")
    return graph.label_distribution(rows, ["user_id"]).select("user_id", "entropy", "category")


@query("goal_credibility", "WITH k AS (SELECT frame, event_id AS candidate_id, value / 500 AS confidence, c AS x, r AS y FROM e WHERE event_type = 'click'), s AS (SELECT frame, c AS x, r AS y, value / 500 AS p FROM e WHERE event_type = 'purchase') SELECT k.frame, candidate_id, round(confidence * sum(p / greatest(sqrt(pow(k.x - s.x, 2) + pow(k.y - s.y, 2)), 0.000001)), 6) AS credibility FROM k JOIN s USING (frame) GROUP BY k.frame, candidate_id, confidence")
def goal_credibility(t: Tables):
    k = t.e.where("event_type = 'click'").selectExpr("frame", "event_id as candidate_id", "value / 500 as confidence", "c as x", "r as y")
    s = t.e.where("event_type = 'purchase'").selectExpr("frame", "c as x", "r as y", "value / 500 as p")
    return graph.credibility(k, s, ["frame"]).select("frame", "candidate_id", "credibility")


@query("unobstructed_pairs", f"WITH o AS (SELECT frame, event_id AS id, r, c FROM e), p AS (SELECT x.frame, x.id AS a, y.id AS b, x.r AS r0, x.c AS c0, y.r AS r1, y.c AS c1, sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) AS d FROM o x JOIN o y ON x.frame = y.frame AND x.id < y.id WHERE sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2)) <= 6), {LINE}, hit AS (SELECT DISTINCT frame, a, b FROM k JOIN occupied USING (frame, r, c)) SELECT p.frame, CAST(1 AS BIGINT) AS room_id, p.a, p.b, round(d, 6) AS distance FROM p LEFT JOIN hit ON hit.frame = p.frame AND hit.a = p.a AND hit.b = p.b WHERE hit.a IS NULL")
def unobstructed_pairs(t: Tables):
    objects = t.e.selectExpr("frame", "1 as room_id", "event_id as point_id", "cast(c as double) as x", "cast(r as double) as y")
    return graph.unobstructed_pairs(objects, t.occupied, ["frame"], 6.0)


@query("door_conflicts", """WITH l AS (SELECT frame, r AS candidate_id, list(c) AS cs FROM lines GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY len(cs) DESC, candidate_id) AS n FROM l),
f(frame, n, candidate_id, taken, kept) AS (SELECT DISTINCT frame, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), false FROM o UNION ALL
SELECT f.frame, o.n, o.candidate_id, CASE WHEN list_has_any(f.taken, o.cs) THEN f.taken ELSE list_concat(f.taken, o.cs) END, NOT list_has_any(f.taken, o.cs) FROM f JOIN o ON o.frame = f.frame AND o.n = f.n + 1)
SELECT frame, candidate_id, kept FROM f WHERE n > 0""", recursive=True)
def door_conflicts(t: Tables):
    lines = t.lines.groupBy("frame", "r").agg(F.collect_list(F.struct(F.col("c").alias("r"), F.lit(0).alias("c"))).alias("cells")).selectExpr("frame", "cast(r as long) as candidate_id", "cast(size(cells) as double) as score", "cells")
    return doors.without_conflicts(lines, ["frame"])


@query("quality_gate", "SELECT 'positive' AS rule, count(*) FILTER (NOT (o_totalprice > 100000)) AS failures FROM orders UNION ALL SELECT 'known', count(*) FILTER (NOT (o_orderstatus IN ('F', 'O'))) FROM orders")
def quality_gate(t: Tables):
    return sinks.gate(t.orders, {"positive": "o_totalprice > 100000", "known": "o_orderstatus in ('F', 'O')"})


@query("complete_results", "SELECT o_orderkey, o_orderstatus, 'none' AS stop_reason, CASE WHEN o_custkey % 2 = 0 THEN 'greedy' ELSE 'default' END AS policy FROM orders")
def complete_results(t: Tables):
    rows = t.orders.selectExpr("o_orderkey", "o_orderstatus", "if(o_custkey % 2 = 0, 'greedy', null) as policy")
    return sinks.completed_results(rows, {"policy": "default", "stop_reason": "none"})


@query("missing_outputs", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
def missing_outputs(t: Tables):
    return sinks.missing_only(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 40").selectExpr("l_orderkey as o_orderkey"), ["o_orderkey"])


@query("swap_label_layer", "SELECT g.scene, g.r, g.c, coalesce(p.label, 0) AS final_label, 'moved' AS baseline FROM gt g LEFT JOIN pred p USING (scene, r, c)")
def swap_label_layer(t: Tables):
    return sinks.with_label_layer(t.gt.withColumnRenamed("label", "final_label"), t.pred, KEYS, "moved")
