"""Queries of windows and state machines, as batches."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..streaming import machines, windows
from .queries_voxels import FOLD
from .registry import Tables, query


@query("tumbling", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(t: Tables):
    return windows.tumbling(t.events, "ts", "1 hour", ["event_type"])


@query("sliding", "SELECT event_type, b - INTERVAL '1 hour' * k AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL '1 hour', ts) AS b FROM events), range(0, 2) g(k) GROUP BY ALL")
def sliding(t: Tables):
    return windows.sliding(t.events, "ts", "2 hours", "1 hour", ["event_type"])


@query("session", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM k GROUP BY user_id, k")
def session(t: Tables):
    return windows.session(t.events, "ts", "30 minutes", ["user_id"])


def _candidates(t: Tables):
    """Lines of cells that come back step after step, by scene."""
    cells = "transform(sequence(c % 8, c % 8 + 5), x -> named_struct('r', cast(r % 4 * 5 as int), 'c', cast(x as int))) as cells"
    return t.e.selectExpr("user_id % 5 as scene", "step", "event_id as candidate_id", cells, "occ or z > 2 as accepted", "z > 1 as verified", "2.7D + if(step > 10, 0.1D, 0.0D) as ceiling_m", "transform(sequence(0, 7), x -> named_struct('r', cast(r % 4 * 5 as int), 'c', cast(x as int))) as observed")


@query("separator_memory")
def separator_memory(t: Tables):
    return machines.in_batch(_candidates(t), ["scene"], "step", machines.separator_memory, machines.OUTPUTS["separator_memory"])


@query("door_memory")
def door_memory(t: Tables):
    return machines.in_batch(_candidates(t), ["scene"], "step", machines.door_memory, machines.OUTPUTS["door_memory"])


@query("object_memory")
def object_memory(t: Tables):
    rows = t.e.selectExpr("user_id % 10 as scene", "step", "event_id as detection_id", "cast(r as double) as x", "cast(c as double) as y", "value / 500 as confidence", "event_type as category")
    return machines.in_batch(rows, ["scene"], "step", partial(machines.object_memory, radius=5.0), machines.OUTPUTS["object_memory"])


@query("terminal_registry", "WITH q AS (SELECT user_id % 10 AS scene, step, event_id, r, c, event_id % 7 = 0 AS mark FROM e) SELECT scene, step, event_id AS query_id, EXISTS (SELECT 1 FROM q m WHERE m.mark AND m.scene = q.scene AND m.step < q.step AND m.step + 3 >= q.step AND sqrt(pow(m.r - q.r, 2) + pow(m.c - q.c, 2)) <= 1) AS suppressed FROM q WHERE NOT mark")
def terminal_registry(t: Tables):
    rows = t.e.selectExpr("user_id % 10 as scene", "step", "event_id as query_id", "if(event_id % 7 = 0, 'mark', 'query') as kind", "cast(r as double) as r", "cast(c as double) as c", "cast(null as double) as target_r", "cast(null as double) as target_c", "3 as suppress_steps")
    return machines.in_batch(rows, ["scene"], "step", machines.terminal_registry, machines.OUTPUTS["terminal_registry"])


@query("frontier_commitment", """WITH a AS (SELECT user_id % 10 AS scene, step, c % 6 AS id, max(value) AS s FROM e GROUP BY ALL),
g AS (SELECT scene, step, list(id ORDER BY id) AS ids, list(s ORDER BY id) AS ss, list(id ORDER BY s DESC, id)[1] AS best, max(s) AS top FROM a GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY step) AS n FROM g),
f(scene, n, step, choice, since, reason) AS (SELECT scene, n, step, best, step, 'initial' FROM o WHERE n = 1 UNION ALL
SELECT scene, n, step, CASE WHEN reason = 'kept' THEN choice ELSE best END, CASE WHEN reason = 'kept' THEN since ELSE step END, reason FROM (
SELECT o.scene, o.n, o.step, f.choice, f.since, o.best, CASE WHEN NOT list_contains(o.ids, f.choice) THEN 'gone' WHEN o.step - f.since >= 50 THEN 'timeout' WHEN o.top > o.ss[list_position(o.ids, f.choice)] * 1.2::DOUBLE THEN 'better' ELSE 'kept' END AS reason FROM f JOIN o ON o.scene = f.scene AND o.n = f.n + 1))
SELECT scene, step, choice AS frontier_id, reason FROM f""", recursive=True)
def frontier_commitment(t: Tables):
    rows = t.e.selectExpr("user_id % 10 as scene", "step", "c % 6 as frontier_id", "value").groupBy("scene", "step", "frontier_id").agg(F.max("value").alias("score"))
    return machines.in_batch(rows, ["scene"], "step", machines.commitment, machines.OUTPUTS["commitment"])


@query("room_ids")
def room_ids(t: Tables):
    rows = t.e.selectExpr("user_id % 5 as scene", "step", "r div 10 as label", "r", "c").groupBy("scene", "step", "label").agg(F.sort_array(F.collect_set(F.struct(F.col("r"), (F.col("c") % 8).alias("c")))).alias("cells"))
    return machines.in_batch(rows, ["scene"], "step", machines.room_ids, machines.OUTPUTS["room_ids"])


@query("incremental_fold", FOLD.replace("r % 10 AS r, c % 10 AS c", "r, c") + " SELECT * FROM state", recursive=True)
def incremental_fold(t: Tables):
    events = t.e.groupBy("step", "z", "r", "c").agg(F.count(F.when(~F.col("occ"), 1)).alias("free"), F.count(F.when(F.col("occ"), 1)).alias("occupied"))
    first = windows.folded_on(None, events.where("step < 10"), ["z", "r", "c"])
    return windows.folded_on(first, events.where("step >= 10"), ["z", "r", "c"])
