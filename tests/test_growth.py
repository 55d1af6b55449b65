"""What keeps steps in bounds as tables grow: machines take a key's rows some at a time, spread cells are not broadcast, groups have no pairs by the square."""

import math
import random
import statistics

import numpy as np

from gridloom.operators import cuts, doors, frontier, graph, grids, kernels, matching, navigation, partition, raster, rooms, runs, seed_lines, separators, voxels, wall_lines
from gridloom.plans import registry
from gridloom.streaming import machines


def plan_of(df) -> str:
    """The plan as run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df, kind: str = "JoinExec", metric: str = "numOutputRows") -> int:
    """The most rows that a join (or node of another kind) of the plan as run gave."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], [0]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if name.endswith(kind) and node.metrics().contains(metric):
            found.append(node.metrics().apply(metric).value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_a_long_history_is_no_single_batch(spark):
    """F1, F14, F22, F25, F33"""
    sums = lambda state, step, rows: ({"n": state.get("n", 0) + len(rows)}, [{"n": state.get("n", 0) + len(rows), "steps": step}])
    df = spark.range(60_000).selectExpr("cast(id % 2 as int) as scene", "(id * 7919) % 30000 div 2 as step")
    got = machines.in_batch(df, ["scene"], "step", sums, "n long, steps long")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    want, seen = {}, {}
    for scene, step, n in sorted((r.scene, r.step, r.n) for r in df.groupBy("scene", "step").agg({"*": "count"}).toDF("scene", "step", "n").collect()):
        seen[scene] = seen.get(scene, 0) + n
        want[scene, step] = seen[scene]
    assert {(r.scene, r.step): r.n for r in got.collect()} == want


def test_tracks_of_equal_shape_are_taken_in_order():
    """Against a look at every track."""
    rng = random.Random(5)
    shapes = [[[r, c] for c in range(a, a + 4)] for r in (0, 1) for a in range(5)]
    tracks = [{"id": i, "cells": rng.choice(shapes)} for i in range(40)]
    unseen, left = machines._Unseen(tracks), list(tracks)
    for _ in range(60):
        cells = rng.choice(shapes)
        best = max(left, key=lambda t: (machines.iou(t["cells"], cells), -t["id"]), default=None)
        want = best if best and machines.iou(best["cells"], cells) >= 0.3 else None
        assert unseen.take(cells, 0.3) is want
        left = [t for t in left if t is not want]


def test_a_border_is_sparse_from_twice_its_cells(spark):
    """Five cells over a span of nine are no sparse border, over ten they are."""
    def label(scene, places):
        return [(scene, r, c, lab) for c in places for r, lab in ((0, 1), (1, 2))]

    cells = spark.createDataFrame(label("nine", [0, 2, 4, 6, 8]) + label("ten", [0, 2, 4, 6, 9]), "scene string, r int, c int, label int")
    none = cells.where("label > 9")
    got = {r.scene: (r.border, r.neck, r.reason) for r in navigation.adjacency_evidence(cells, none, none, ["scene"], 0).collect()}
    assert got == {"nine": (5, 9, "open"), "ten": (5, 10, "sparse")}


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    """F18"""
    values = [0.9261604999999999, -0.9261604999999999, 29.27, 0.0000005, 123456789012345.67, float("inf"), None, -0.0000004]
    got = [r.x for r in registry._plain(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)).collect()]
    assert got == [0.926161, -0.926161, 29.27, 0.000001, 123456789012345.67, float("inf"), None, 0.0]


def test_spread_cells_are_not_broadcast(spark):
    """F6, F7, F10, F12, F13"""
    cells = spark.range(400).selectExpr("id div 100 as frame", "id % 100 div 10 as r", "id % 10 as c")
    marches = cells.selectExpr("frame", "r * 10 + c as march_id", "r", "c", "0 as dr", "1 as dc")
    seeds = cells.where("c = 3")
    unknown = raster.complement(cells, cells, ["frame"], 20, 20)
    for found in (runs.first_hits(marches, ["frame"], seeds, seeds.limit(0), 20), frontier.frontier_cells(cells, seeds, unknown, ["frame"], 20, 20, 1, 1), raster.snapped(cells, seeds, ["frame"], 5), raster.close(cells, ["frame"], raster.disk(2), 20, 20)):
        assert "Broadcast" not in plan_of(found)


def test_parallel_lines_by_places_as_line_by_line(spark):
    """many lines of few places; each live line meets the first later one that fits."""
    rng = random.Random(3)
    rows = [("f", "horizontal", i % 270, rng.randrange(6), a := rng.randrange(5), a + rng.randrange(1, 5)) for i in range(300)]
    for near, far in ((2, 4), (0, 2)):
        order, gone = sorted(rows, key=lambda x: (x[3], x[4], x[5], x[2])), set()
        for i, a in enumerate(order):
            for b in order[i + 1 :] if a[2] not in gone else []:
                la, lb = a[5] - a[4] + 1, b[5] - b[4] + 1
                if b[2] not in gone and near <= b[3] - a[3] <= far and abs(la - lb) <= 0.2 * max(la, lb) and abs(a[4] + a[5] - b[4] - b[5]) / 2 <= 0.5 * max(la, lb):
                    gone |= {a[2], b[2]}
                    break
        df = spark.createDataFrame(rows, "frame string, axis string, line_id int, scan int, first int, last int")
        got = navigation.without_parallel(df, ["frame"], near, far, 0.2, 0.5)
        assert gone and sorted(tuple(r) for r in got.collect()) == sorted(x for x in rows if x[2] not in gone)


def test_first_fit_by_places_as_run_by_run(spark):
    """equal runs, and runs too short to fit themselves."""
    rng = random.Random(4)
    rows = [("f", "horizontal", i, rng.randrange(8), a := rng.randrange(30), a + rng.randrange(3)) for i in range(250)]
    df = spark.createDataFrame(rows, "frame string, axis string, run_id int, line int, first int, last int")
    for lateral, most_gap, least_overlap in ((1, 0, 1), (1, 2, 1), (2, 0, 2), (0, -1, 3)):
        groups = []
        for x in sorted(rows, key=lambda x: (x[3], x[4], x[5], x[2])):
            def fits(m, x=x):
                overlap = min(x[5], m[5]) - max(x[4], m[4]) + 1
                return abs(x[3] - m[3]) <= lateral and (overlap >= least_overlap or 0 <= -overlap <= most_gap)
            home = next((g for g in groups if any(map(fits, g))), None)
            groups.append([x]) if home is None else home.append(x)
        want = [(i, statistics.median(m[3] for m in g), min(m[4] for m in g), max(m[5] for m in g), len(g)) for i, g in enumerate(groups)]
        got = runs.merged_first_fit(df, ["frame"], lateral, most_gap, least_overlap)
        assert sorted((r.group_id, r.line, r.first, r["last"], r.members) for r in got.collect()) == want


def test_gaps_of_runs_make_no_pair_that_does_not_fit(spark):
    """the join itself asks for line and start."""
    df = spark.range(50).selectExpr("1 as frame", "id as run_id", "'horizontal' as axis", "id % 5 as line", "id % 11 * 4 as first", "id % 11 * 4 + id % 3 as last", "1.0D as confidence")
    got = runs.run_gaps(df, ["frame"], 1, 4)
    assert "first_b" in [line for line in plan_of(got).splitlines() if "SortMergeJoin" in line][0]
    rows = df.collect()
    want = {(a.run_id, b.run_id) for a in rows for b in rows if a.run_id != b.run_id and abs(a.line - b.line) <= 1 and 0 < b.first - a["last"] - 1 < 4}
    assert want and {(r.a, r.b) for r in got.collect()} == want
    assert runs.run_gaps(df, ["frame"], 1, 1).count() == 0


def test_episodes_put_few_pairs_in_order(spark):
    """as ordering all pairs; a scene with fewer pairs keeps all."""
    starts = spark.range(60).selectExpr("if(id < 58, 0, 1) as scene", "id as start_id", "cast(id * 7 % 31 as double) as x", "cast(id * 5 % 29 as double) as y")
    goals = spark.range(90).selectExpr("if(id < 88, 0, 1) as scene", "id as goal_id", "cast(id * 3 % 31 as double) as x", "cast(id * 11 % 29 as double) as y")
    got = navigation.episodes(starts, goals, ["scene"], 7, 10, 4.0, 20.0)
    every = starts.join(goals.withColumnsRenamed({"x": "gx", "y": "gy"}), "scene").where("sqrt(pow(x - gx, 2) + pow(y - gy, 2)) between 4 and 20").selectExpr("scene", "start_id", "goal_id", "row_number() over (partition by scene order by xxhash64(7, scene, start_id, goal_id)) as episode").where("episode <= 10")
    assert sorted(tuple(r) for r in got.select(*every.columns).collect()) == sorted(tuple(r) for r in every.collect())
    assert "__most" in plan_of(got)


def test_episodes_shuffle_only_pairs_under_the_bound(spark):
    """of over a million pairs only their counts by hash leave the task that makes them."""
    starts = spark.range(2000).selectExpr("id % 2 as scene", "id as start_id", "cast(id * 7 % 31 as double) as x", "cast(id * 5 % 29 as double) as y")
    goals = spark.range(2400).selectExpr("id % 2 as scene", "id as goal_id", "cast(id * 3 % 31 as double) as x", "cast(id * 11 % 29 as double) as y")
    got = navigation.episodes(starts, goals, ["scene"], 7, 10, 4.0, 20.0)
    every = starts.join(goals.withColumnsRenamed({"x": "gx", "y": "gy"}), "scene").where("sqrt(pow(x - gx, 2) + pow(y - gy, 2)) between 4 and 20")
    assert every.count() > 1_000_000
    best = every.selectExpr("scene", "start_id", "goal_id", "row_number() over (partition by scene order by xxhash64(7, scene, start_id, goal_id), start_id, goal_id) as episode").where("episode <= 10")
    assert sorted(tuple(r) for r in got.select(*best.columns).collect()) == sorted(tuple(r) for r in best.collect())
    assert 0 < most_rows(got, "ShuffleExchangeExec", "shuffleRecordsWritten") < 500_000


def test_gaps_are_not_spread_into_cells(spark):
    """counts come from words; lines and places off the map, both axes, gaps over the ends of tiles."""
    rng = random.Random(2)
    runs_ = [(f, i, rng.choice(["horizontal", "vertical"]), rng.randrange(-2, 14), a := rng.randrange(-20, 300), a + rng.randrange(3), rng.random()) for f in (0, 1) for i in range(300)]
    cells = lambda n: list({(rng.randrange(2), rng.randrange(-3, 290), rng.randrange(-3, 290)) for _ in range(n)})
    free, unknown, rules = cells(60_000), cells(30_000), separators.GapRules()
    table = lambda rows: spark.createDataFrame(rows, "frame int, r int, c int")
    got = separators.facing_gaps(spark.createDataFrame(runs_, "frame int, run_id int, axis string, line int, first int, last int, confidence double"), table(free), table(unknown), ["frame"], 280, 270, rules)
    assert "sequence(first" not in plan_of(got)
    f, u, want = set(free), set(unknown), set()
    for a in runs_:
        for b in runs_:
            if a[0] == b[0] and a[2] == b[2] and abs(a[3] - b[3]) <= 4 and 1 <= b[4] - a[5] - 1 <= rules.most_cells:
                line, across = round((a[3] + b[3]) / 2), a[2] == "horizontal"
                on = [(a[0], *x) for x in ((line, p) if across else (p, line) for p in range(a[5] + 1, b[4])) if 0 <= x[0] < 280 and 0 <= x[1] < 270]
                want.add((a[0], a[2], line, a[5] + 1, b[4] - 1, *(round(sum(x in s for x in on) / len(on), 6) if on else 0.0 for s in (f, u))))
    found = {(r.frame, r.axis, r.line, r.first, r["last"], round(r.free_ratio, 6), round(r.unknown_ratio, 6)) for r in got.collect()}
    # gaps without a kind give no row
    assert len(found) > 300 and found <= want


def test_distances_meet_rows_not_all_places_within_reach(spark):
    """a row of cells and a column of targets meet once, whatever the reach."""
    rng = random.Random(5)
    cells = {(rng.randrange(2), rng.randrange(30), rng.randrange(50)) for _ in range(300)}
    targets = {(0, rng.randrange(-4, 34), rng.randrange(-4, 54)) for _ in range(12)}
    table = lambda rows: spark.createDataFrame(list(rows), "frame int, r int, c int")
    for reach in (3, 9, 200):
        got = raster.squared_distance(table(cells), table(targets), ["frame"], reach)
        assert "Generate" not in plan_of(got)
        want = {x: min((d for t in targets if t[0] == x[0] and (d := (t[1] - x[1]) ** 2 + (t[2] - x[2]) ** 2) <= reach * reach), default=None) for x in cells}
        assert {(r.frame, r.r, r.c): r.d2 for r in got.collect()} == want


def test_nearest_meets_places_not_rows(spark):
    """many points and queries of few places; ties go to the smallest id."""
    points = spark.range(3000).selectExpr("id as point_id", "cast(id * 37 % 11 as double) as x", "cast(id * 53 % 7 as double) as y")
    queries = spark.range(4000).selectExpr("id % 3900 as query_id", "cast(id * 29 % 13 as double) - 0.5D as x", "cast(id * 31 % 9 as double) as y")
    got = matching.nearest(queries, points, 2.0)
    assert most_rows(got) <= 13 * 9 * 11 * 7
    p, best = [tuple(r) for r in points.collect()], {}
    first = {}
    for i, x, y in p:
        first.setdefault((x, y), i)
    for q, x, y in queries.collect():
        near = [(d, i) for (a, b), i in first.items() if (d := math.hypot(a - x, b - y)) < 2]
        if near:
            best[q] = min([*near, *([best[q]] if q in best else [])])
    assert {r.query_id: (r.distance, r.point_id) for r in got.collect()} == best


def test_top_terms_shuffle_no_pair(spark):
    """a frontier's terms are summed and put in order where they arise, some hundred subgraphs at a time; null and endless terms too."""
    f = spark.range(40).selectExpr("id % 3 as frame", "id as frontier_id", "cast(id % 7 as double) as x", "cast(id % 5 as double) as y")
    s = spark.range(1500).selectExpr("id % 2 as frame", "id as subgraph_id", "cast(id * 3 % 50 as double) as x", "cast(id * 7 % 40 as double) as y", "case when id = 5 then null when id = 9 then cast('NaN' as double) else cast(id % 9 as double) end as p")
    got = matching.frontier_scores(f, s, ["frame"])
    assert not any("Window" in line and "frontier_id" in line for line in plan_of(got).splitlines())
    d = "greatest(sqrt(pow(f.x - s.x, 2) + pow(f.y - s.y, 2)), 1e-6)"
    f.createOrReplaceTempView("f36"), s.createOrReplaceTempView("s36")
    terms = spark.sql(f"select f.frame, frontier_id, subgraph_id, p / {d} as term from f36 f join s36 s using (frame)").toPandas()
    found = {r.frontier_id: r for r in got.collect()}
    assert set(found) == set(terms.frontier_id)
    for key, g in terms[terms.frame == 0].groupby("frontier_id"):
        g = g[(g.subgraph_id != 5) & (g.subgraph_id != 9)].sort_values(["term", "subgraph_id"], ascending=[False, True])
        assert [k.subgraph_id for k in found[key].contributors] == list(g.subgraph_id[:3])
        assert abs(found[key].score - g.term.sum()) < 1e-6


def test_swept_lines_meet_the_widened_obstacles(spark):
    """a line's cells are not widened, the obstacles are."""
    rng = random.Random(20)
    moves = [(rng.randrange(2), i, *(rng.randrange(20) for _ in range(4))) for i in range(200)]
    blocked = [(0, rng.randrange(20), rng.randrange(20)) for _ in range(6)]
    got = navigation.swept_clear(spark.createDataFrame(moves, "frame int, move_id int, r0 int, c0 int, r1 int, c1 int"), spark.createDataFrame(blocked, "frame int, r int, c int"), ["frame"], 2)
    assert 0 < most_rows(got, "GenerateExec") <= 20 * 200

    def clear(f, r0, c0, r1, c1):
        n = max(abs(r1 - r0), abs(c1 - c0))
        line = [(round(r0 + (r1 - r0) * i / max(n, 1)), round(c0 + (c1 - c0) * i / max(n, 1))) for i in range(n + 1)]
        return not any(g == f and (r - a) ** 2 + (c - b) ** 2 <= 4 for g, a, b in blocked for r, c in line)

    assert {(r.frame, r.move_id): r.clear for r in got.collect()} == {(m[0], m[1]): clear(m[0], *m[2:]) for m in moves}


def jobs_of(spark, name, make):
    """What a function gives, and how many jobs it ran by itself."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return make(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_cuts_do_not_repeat_the_graph_of_a_frame(spark):
    """a frame's cuts are tried in its task; cells off the map, cuts off the ground, names as ids."""
    free = {(r, c) for r in range(-1, 4) for c in range(9)}
    dark = {(-2, 4), (4, 0), (4, 1), (1, 9)}
    lines = {"across": [(r, 4) for r in range(-1, 4)], "half": [(r, 4) for r in range(3)], "off": [(8, 8)], "corner": [(0, 0), (9, 9)]}
    table = lambda rows: spark.createDataFrame(list(rows), "frame string, r int, c int")
    cut_table = spark.createDataFrame([("f", i, *p) for i, ps in lines.items() for p in ps], "frame string, cut_id string, r int, c int")
    got, jobs = jobs_of(spark, "f9", lambda: cuts.sides_of_cuts(table(("f", *p) for p in free), table(("f", *p) for p in dark), cut_table, ["frame"], 6, 10))
    assert jobs == 0
    beside = lambda ps: {(r + a, c + b) for r, c in ps for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))} - set(ps)
    want = {}
    for i, ps in lines.items():
        own, left, sides = set(ps) & free, free - set(ps), []
        while own and (start := left & beside(own)):
            part = {min(start)}
            while more := beside(part) & left:
                part |= more
            left -= part
            rim = {p for p in beside(part) - free if 0 <= p[0] < 6 and 0 <= p[1] < 10}
            rows, columns = [p[0] for p in part], [p[1] for p in part]
            contact = len(beside(part) & own)
            sides.append((-len(part), min(rows), min(columns), len(part), max(rows), max(columns), contact, len(rim) + contact, len(rim & dark)))
        if own:
            want[i] = (len(sides) - 1, [x[1:] for x in sorted(sides)])
    assert {x.cut_id: (x.gain, [tuple(s) for s in x.sides]) for x in got.collect()} == want


def test_a_skeleton_takes_no_round_of_tables(spark):
    """a frame is peeled in its task."""
    ring = [(f, r, c) for f in (-3, 7) for r in range(-6, 7) for c in range(-6, 7) if 9 <= r * r + c * c <= 36]
    got, jobs = jobs_of(spark, "f21", lambda: cuts.thinned(spark.createDataFrame(ring, "frame int, r long, c int"), ["frame"]))
    assert jobs == 0 and dict(got.dtypes) == {"frame": "int", "r": "bigint", "c": "int"}
    found = {f: {(x.r, x.c) for x in got.collect() if x.frame == f} for f in (-3, 7)}
    assert found[-3] == found[7] and (0, 0) not in found[7]
    # a ring stays one: each cell has two neighbours or more, none has eight
    for r, c in found[7]:
        assert 2 <= sum((r + a, c + b) in found[7] for a in (-1, 0, 1) for b in (-1, 0, 1)) - 1 < 5


def test_bins_of_columns_are_not_broadcast(spark):
    """F8: the known voxels of a map are small on disk and large in memory."""
    known = spark.range(300).selectExpr("id div 100 as frame", "id % 10 as z", "id % 100 div 10 as r", "id % 7 as c", "1 as state", "1 as seen")
    got = rooms.active_bins(known, ["frame"], 12)
    assert "Broadcast" not in plan_of(got)
    assert got.count() == 12 * known.select("frame", "r", "c").distinct().count()


def test_labels_go_out_to_cells(spark):
    """no join repeats the cells by the disk; ties go to the smallest label."""
    rng = random.Random(31)
    labels = {(rng.randrange(2), rng.randrange(12), rng.randrange(12)): rng.randrange(4) for _ in range(30)}
    cells = {(rng.randrange(3), rng.randrange(-2, 14), rng.randrange(-2, 14)) for _ in range(200)}
    got = navigation.absorbed(spark.createDataFrame([(*k, v) for k, v in labels.items()], "frame int, r int, c int, label int"), spark.createDataFrame(list(cells), "frame int, r int, c int"), ["frame"], 3)
    assert 0 < most_rows(got, "GenerateExec") <= 29 * len(labels)
    want = {}
    for x in cells:
        near = [((k[1] - x[1]) ** 2 + (k[2] - x[2]) ** 2, v) for k, v in labels.items() if k[0] == x[0] and v > 0]
        if near and min(near)[0] <= 9:
            want[x] = min(near)
    assert {(r.frame, r.r, r.c): (r.d2, r.label) for r in got.collect()} == want


def test_pairs_of_cuts_carry_what_they_need(spark):
    """pairs are not joined with their ends again."""
    one = spark.range(40).selectExpr("id % 2 as frame", "id as candidate_id", "cast(id * 7 % 11 as double) as x", "cast(id * 5 % 9 as double) as y", "cast(id as double) as score", "array(named_struct('r', id % 3, 'c', id % 2)) as cells")
    got = navigation.compound_cuts(one, ["frame"], 3.0)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rows = one.collect()
    want = {(a.candidate_id, b.candidate_id, a.score + b.score, len({tuple(a.cells[0]), tuple(b.cells[0])})) for a in rows for b in rows if a.frame == b.frame and a.candidate_id < b.candidate_id and math.hypot(a.x - b.x, a.y - b.y) <= 3}
    assert want and {(r.a, r.b, r.score, len(r.cells)) for r in got.collect()} == want


def test_dilation_and_erosion_group_words_not_cells(spark):
    """F35"""
    full = raster.whole(spark.range(3).withColumnRenamed("id", "frame").coalesce(1), ["frame"], 40, 64)
    closed = raster.close(full, ["frame"], raster.disk(2), 40, 64)
    assert most_rows(closed, "AggregateExec") < 1_000
    assert closed.count() == 3 * 36 * 60
    rng = random.Random(35)
    cells = {(rng.randrange(-2, 22), rng.randrange(-3, 153)) for _ in range(2_000)}
    df = spark.createDataFrame(sorted(cells), "r int, c int")
    for offsets in (raster.CROSS, raster.disk(3), [(1, 30), (-2, -30), (0, 70)]):
        grown = [tuple(x) for x in raster.dilate(df, [], offsets, 20, 150).collect()]
        assert sorted(grown) == sorted({(r + a, c + b) for r, c in cells for a, b in offsets if 0 <= r + a < 20 and 0 <= c + b < 150})
        left = [tuple(x) for x in raster.erode(df, [], offsets, 20, 150).collect()]
        assert sorted(left) == [(r, c) for r in range(20) for c in range(150) if all((r + a, c + b) in cells for a, b in offsets)]


def test_a_step_of_a_walk_is_no_row(spark):
    """F23"""
    starts = spark.range(40).selectExpr("0L as frame", "id as walk_id", "cast(id as int) as r", "5 as c", "0D as dir_r", "if(id = 7, 0D, 1D) as dir_c")
    walls = spark.range(20).selectExpr("0L as frame", "cast(id as int) as r", "20 as c")
    got = wall_lines.walks(starts, walls, ["frame"], 40, 64, other=walls.selectExpr("frame", "r", "9 as c"), rules=wall_lines.WalkRules(most_steps=32, strip=0, snap=0))
    assert most_rows(got, "ExecBase") <= 100 and most_rows(got, "GenerateExec") == 0 and most_rows(got, "JoinExec") == 0
    rows = {r.walk_id: (r.status, r.steps, r.anchor and tuple(r.anchor), r.other_hits) for r in got.collect()}
    assert rows == {i: ("zero_direction", 0, None, 0) if i == 7 else ("hit_wall", 15, (i, 20), 1) if i < 20 else ("extend_max_without_wall", 32, None, 0) for i in range(40)}


def test_cells_of_extensions_are_words(spark):
    """F27"""
    lines = spark.range(30).selectExpr("0L as frame", "id as line_id", "cast(id as int) as r", "explode(sequence(-3, 96)) as c").coalesce(1)
    occupied = lines.where("line_id < 20 and c between 50 and 79").select("frame", "r", "c")
    got = wall_lines.occupied_extensions(lines, occupied, occupied.where("c = 60"), lines.where("c = 61"), ["frame"])
    assert most_rows(got, "AggregateExec") < 300 and most_rows(got) < 300
    rows = {r.line_id: (r.occupied, r.surface, r.rejected) for r in got.collect()}
    assert rows == {i: (0, 28, False) if i in (0, 19) else (26, 2, True) if i < 20 else (0, 0, False) for i in range(30)}


def _parts(cells: set) -> list[set]:
    found = []
    for start in sorted(cells):
        if not any(start in part for part in found):
            part, front = {start}, [start]
            while front:
                r, c = front.pop()
                fresh = {(r + a, c + b) for a, b in kernels.STEPS4} & cells - part
                part |= fresh
                front += fresh
            found.append(part)
    return found


def test_a_cut_labels_no_raster(monkeypatch):
    """against parts counted anew for each cut."""
    monkeypatch.setattr(kernels, "label", None)
    rng = np.random.default_rng(26)
    accepted = closed = 0
    for _ in range(60):
        free = rng.random((9, 11)) < 0.7
        cuts = [np.array([(r, c) for r in range(a, a + n)], int).reshape(-1, 2) for a, c, n in rng.integers(0, [4, 11, 6], (12, 3))]
        now, want = set(map(tuple, np.argwhere(free).tolist())), []
        beside = lambda cut: [p for p in _parts(now - cut) if any((r + a, c + b) in p for r, c in cut for a, b in kernels.STEPS8)]
        ends = lambda x: all(any(not (0 <= r + a < 9 and 0 <= c + b < 11 and free[r + a, c + b]) for a in (-1, 0, 1) for b in (-1, 0, 1)) for r, c in (x[0], x[-1]))
        reasons = ["empty_cut" if not len(x) else "open_end" if not ends(x.tolist()) else "closed" if len(beside(set(map(tuple, x.tolist())))) >= 2 else "one_side" for x in cuts]
        assert kernels.closed_cuts(free, cuts, 1) == [(x == "closed", x) for x in reasons]
        for x in cuts:
            cut = set(map(tuple, x.tolist())) & now
            sides = beside(cut)
            want.append(0 < len(cut) <= 4 and len(_parts(now - cut)) > len(_parts(now)) and len(sides) >= 2 and min(map(len, sides)) >= 2)
            now = now - cut if want[-1] else now
        assert kernels.accepted_cuts(free, cuts, 2, 4) == want
        accepted, closed = accepted + sum(want), closed + reasons.count("closed")
    assert accepted > 20 and closed > 20


def test_halving_floods_no_frame_again(spark):
    """F32"""
    free = raster.whole(spark.range(2).withColumnRenamed("id", "frame"), ["frame"], 12, 30)
    got = grids.segmented(free, ["frame"], 12, 30, "watershed")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    assert got.count() == 2 * 12 * 30


def exchanges(df) -> list[str]:
    """The shuffles of the plan as run."""
    return [line for line in plan_of(df).split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in line]


def test_cells_of_rays_are_not_shuffled(spark, monkeypatch):
    """rays are dealt by the cells that they cross; ends off the map, rays without an origin."""
    monkeypatch.setattr(voxels, "CELLS_A_TASK", 200, raising=False)
    rays = spark.range(300).selectExpr("id % 5 as step", "id % 3 = 0 as is_hit", "0.5D as oz", "if(id = 0, null, id % 7 + 0.5D) as or_", "0.5D as oc", "0.5D as ez", "id % 7 + 0.5D as er", "id % 11 + 0.5D as ec")
    got = voxels.ray_events(rays, ["step"], (1, 6, 9))
    work = sum(i % 11 + 1 for i in range(1, 300)) + 320
    (one,) = exchanges(got)
    assert f", {math.ceil(work / 200)}), REPARTITION_BY_NUM" in one
    want = {}
    for i in range(300):
        cells = [(c, 0) for c in range(i % 11 + 1)] if i else []
        for c, occupied in [*cells[: len(cells) - 1], (i % 11, 1)] if i % 3 == 0 else cells:
            if i % 7 < 6 and c < 9:
                want.setdefault((i % 5, 0, i % 7, c), [0, 0])[occupied] += 1
    assert {(x.step, x.z, x.r, x.c): [x.free, x.occupied] for x in got.collect()} == want


def test_cells_of_groups_stay_in_their_task(spark, monkeypatch):
    """tasks come by the number of cells; no candidate is shuffled."""
    cells = spark.range(2000).selectExpr("id div 50 as g", "cast(id % 2 * 5 as int) as r", "cast(id % 50 div 2 as int) as c").where("g % 3 > 0 or r = 0 or c in (4, 9)")
    for f in (seed_lines.parallel_runs, seed_lines.spur_pruned, seed_lines.primitives):
        found = []
        for share in (1000, 100):
            tasks = math.ceil(cells.count() / share)
            monkeypatch.setattr(seed_lines, "CELLS_A_TASK", share, raising=False)
            got = f(cells, ["g"])
            shuffles = exchanges(got)
            assert any(f", {tasks}), REPARTITION_BY_NUM" in x for x in shuffles)
            assert not any("method" in x for x in shuffles)
            found.append(sorted(map(tuple, got.collect()), key=str))
        assert found[0] and found[0] == found[1]


def test_boxes_of_clusters_are_not_broadcast(spark, monkeypatch):
    """neither the pairs of tiles nor the roots go through the driver."""
    plans, write = [], raster.cut
    monkeypatch.setattr(raster, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    shapes = spark.range(90).selectExpr("id % 2 as frame", "cast(id as int) as label", "cast(id * 7 % 30 as int) as r0", "cast(id * 7 % 30 + id % 3 as int) as r1", "cast(id * 11 % 25 as int) as c0", "cast(id * 11 % 25 + id % 4 as int) as c1", "id * 7 % 30 + id % 3 / 2D as centre_r", "id * 11 % 25 + id % 4 / 2D as centre_c", "cast(id % 2 as double) as dir_r", "cast(1 - id % 2 as double) as dir_c")
    got = doors.clusters(shapes, ["frame"], 2, 1.5)
    assert not any("Broadcast" in x for x in [*plans, plan_of(got)])
    rows = sorted(shapes.collect(), key=lambda x: x.label)
    root = {x.label: x.label for x in rows}
    for a in rows:
        for b in rows:
            gap = max(a.r0 - b.r1, b.r0 - a.r1, a.c0 - b.c1, b.c0 - a.c1, 0)
            lateral = abs((b.centre_r - a.centre_r) * a.dir_c - (b.centre_c - a.centre_c) * a.dir_r)
            if a.frame == b.frame and a.label < b.label and gap <= 2 and lateral <= 1.5:
                low, high = sorted((root[a.label], root[b.label]))
                root = {k: low if v == high else v for k, v in root.items()}
    found = {x.label: x.cluster for x in got.collect()}
    assert found == root and len(set(root.values())) < len(root)


def test_gaps_of_runs_shuffle_no_pairs(spark):
    """ids of several runs give no pair twice, and pairs stay in the task that makes them."""
    df = spark.range(480).selectExpr("id % 2 as frame", "id % 37 as run_id", "'horizontal' as axis", "id % 13 * 6 + id % 3 as line", "id % 11 * 4 as first", "id % 11 * 4 + id % 3 as last", "1.0D as confidence")
    rows = df.collect()
    for lateral, most_gap in ((1, 4), (0, 3), (5, 4), (70, 3)):
        got = runs.run_gaps(df, ["frame"], lateral, most_gap)
        plan = plan_of(got)
        assert lateral > 60 or plan.index("SortMergeJoin") < plan.index("Exchange")
        want = {(a.frame, a.run_id, b.run_id, (a.line + b.line) // 2, a["last"] + 1, b.first - 1, b.first - a["last"] - 1) for a in rows for b in rows if a.frame == b.frame and a.run_id != b.run_id and abs(a.line - b.line) <= lateral and 0 < b.first - a["last"] - 1 < most_gap}
        found = [(r.frame, r.a, r.b, r.line, r["from"], r.to, r.gap) for r in got.collect()]
        assert want and len(found) == len(want) and set(found) == want


def test_tables_of_voronoi_rooms_are_not_broadcast(spark, monkeypatch):
    """no table of its steps and rounds goes through the driver."""
    plans, write = [], partition.cut

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(partition, "cut", kept)
    monkeypatch.setattr(raster, "cut", kept)
    # two halls of 10 by 10 with a passage of 3 by 4 between, twice, and a small room beside
    halls = [(f, r, c) for f in (0, 1) for r in range(10) for c in [*range(10), *range(14, 24)]] + [(f, r, c) for f in (0, 1) for r in range(4, 7) for c in range(10, 14)] + [(0, 14, c) for c in range(4)]
    free = spark.createDataFrame(halls, "frame int, r int, c int")
    got = partition.voronoi_rooms(free, ["frame"], 16, 24, resolution=1.0, merge_below=30.0, force_below=6.0, low=2.0, stride=6)
    assert got.count() == len(halls) and len(plans) > 10
    assert not [x for x in plans if "Broadcast" in x] and "Broadcast" not in plan_of(got)


def test_unobstructed_pairs_are_not_shuffled(spark):
    """objects bring the obstacles about them; two words a block, places off the map, empty blocks."""
    rng = random.Random(5)
    things = [(f, f % 2, k, rng.uniform(-12, 30), rng.uniform(-12, 30)) for f in (0, 1) for k in range(500)] + [(0, 9, 900 + k, 200.0 + k, 200.0) for k in range(3)]
    walls = {(rng.randrange(2), rng.randrange(-12, 30), rng.randrange(-12, 30)) for _ in range(200)}
    objects = spark.createDataFrame(things, "frame int, room_id int, point_id long, x double, y double")
    for most in (9.0, 3.5, 33.5):
        got = graph.unobstructed_pairs(objects, spark.createDataFrame(list(walls), "frame int, r int, c int"), ["frame"], most)
        want = set()
        for f, room, a, ax, ay in things:
            for g, other, b, bx, by in things:
                if (f, room) == (g, other) and a < b and math.hypot(bx - ax, by - ay) <= most:
                    (r0, c0), (r1, c1) = (int(ay), int(ax)), (int(by), int(bx))
                    n = max(abs(r1 - r0), abs(c1 - c0))
                    if not any((f, round(r0 + (r1 - r0) * i / max(n, 1)), round(c0 + (c1 - c0) * i / max(n, 1))) in walls for i in range(n + 1)):
                        want.add((f, room, a, b))
        found = [(x.frame, x.room_id, x.a, x.b) for x in got.collect()]
        assert len(found) == len(want) > 900 and set(found) == want
    many = objects.selectExpr("frame", "room_id", "point_id", "x / 4 as x", "y / 4 as y")
    got = graph.unobstructed_pairs(many, spark.createDataFrame(list(walls), "frame int, r int, c int"), ["frame"], 9.0)
    assert got.count() > 20_000 > most_rows(got, "ShuffleExchangeExec", "shuffleRecordsWritten") > 0


def test_necks_are_taken_a_frame_a_task(spark):
    """cells of lines are shuffled once; random frames with cells off the map, against a look at every cell."""
    rng = random.Random(6)
    some = lambda n: list({(rng.randrange(2), rng.randrange(-3, 15), rng.randrange(-3, 21)) for _ in range(n)})
    seeds, walls, real, free = some(30), some(25), some(25), some(260)
    lines = [(f, k, p, r + (p if k % 3 == 0 else 0), c + p, k % 3 == 0) for f in (0, 1) for k in range(40) for r, c in [(rng.randrange(12), rng.randrange(18))] for p in range(-3, 4)]
    table = lambda rows: spark.createDataFrame(rows, "frame int, r int, c int")
    rules = wall_lines.WalkRules(most_inner_walls=1, reject_open=True, least_open=2.0, most_width=2.0)
    got = wall_lines.neck_reasons(spark.createDataFrame(lines, "frame int, line_id long, pos int, r int, c int, diagonal boolean"), table(seeds), table(walls), table(real), table(free), ["frame"], 12, 18, rules)
    plan = plan_of(got)
    assert plan[: plan.index("Initial Plan")].count("Exchange hashpartitioning") == 1
    grown = lambda cells, ok: {(f, r + a, c + b) for f, r, c in cells for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2) if ok(a, b) and 0 <= r + a < 12 and 0 <= c + b < 18}
    near, at = (grown(seeds, lambda a, b, n=n: a * a + b * b <= n) for n in (4, 1))
    inner = {(f, r, c) for f, _, p, r, c, _ in lines if -3 < p < 3}
    bars = {*walls, *real} | (grown(free, lambda a, b: max(abs(a), abs(b)) <= 1) - set(free)) | (inner - set(free))
    want = set()
    for f, k in {x[:2] for x in lines}:
        own = [x for x in lines if x[:2] == (f, k)]
        cells = [(f, x[3], x[4]) for x in own]
        far = [min([(r - a) ** 2 + (c - b) ** 2 for g, a, b in bars if g == f]) for _, r, c in cells[1:-1]]
        open_d2 = None if max(far) > 9 else max(far)
        crossed, touched = sum(x in real and x not in at for x in cells[1:-1]), any(x in near for x in cells)
        why = "door_line_no_seed_overlap" if not touched else "door_line_crosses_real_wall" if crossed > 1 else "door_diagonal_without_support" if k % 3 == 0 and sum(x in walls for x in cells) < 2 else "door_line_crosses_large_open_free" if open_d2 is None or open_d2 > 4 else None
        want.add((f, k, 7, touched, crossed, open_d2, why))
    assert {tuple(x) for x in got.collect()} == want
