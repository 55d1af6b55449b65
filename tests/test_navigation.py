"""Navigation, room evidence and the machines that follow a robot."""

from pyspark.sql import functions as F

from gridloom.operators import doors, frontier, graph, grids, labels, matching, navigation
from gridloom.streaming import machines


def test_a_separator_bounds_the_room(spark):
    cells = spark.createDataFrame([(0, r, c) for r in range(3) for c in range(7)], "frame int, r int, c int")
    wall = cells.where("c = 3")
    start = spark.createDataFrame([(0, 1, 1)], "frame int, r int, c int")
    room = navigation.current_room(cells, cells.limit(0), wall, start, ["frame"], 7)
    assert {r.c for r in room.collect()} == {0, 1, 2} and room.count() == 9
    before = spark.createDataFrame([(0, 0, 6), (0, 9, 9)], "frame int, r int, c int")
    assert navigation.current_room(cells, cells.limit(0), wall, start, ["frame"], 7, before).count() == 10


def test_evidence_between_rooms(spark):
    table = spark.createDataFrame([(0, r, c, 1 if c < 3 else 2) for r in range(4) for c in range(6)], "scene int, r int, c int, label int")
    none = table.limit(0)
    row = navigation.adjacency_evidence(table, none, none, ["scene"]).first()
    assert (row.a, row.b, row.border, row.neck, row.doorway, row.reason) == (1, 2, 4, 4, False, "open")
    door = spark.createDataFrame([(0, 1, 2)], "scene int, r int, c int")
    assert navigation.adjacency_evidence(table, none, door, ["scene"]).first().reason == "doorway"
    merged = navigation.merged_open_rooms(table, navigation.adjacency_evidence(table, none, none, ["scene"]), ["scene"], 4)
    assert {r.label for r in merged.collect()} == {1}


def test_ranges_wrap_around(spark):
    rays = spark.createDataFrame([(0, i, 2.0 if i < 9 else 4.0) for i in range(10)], "scan int, ray int, distance double")
    assert [(r.ray, r.distance) for r in navigation.range_doors(rays, ["scan"], 1.0, 0.1, 3.0).orderBy("ray").collect()] == [(8, 2.0), (9, 2.0)]


def test_parallel_sides_go_in_pairs(spark):
    rows = [(0, "horizontal", i, scan, 0, 9) for i, scan in ((1, 0), (2, 4), (3, 5), (4, 40))]
    df = spark.createDataFrame(rows, "frame int, axis string, line_id int, scan int, first int, last int")
    assert {r.line_id for r in navigation.without_parallel(df, ["frame"], 2, 8, 0.1, 0.1).collect()} == {3, 4}


def test_commands_do_not_overshoot(spark):
    move = navigation.command(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.05), F.lit(0.0), 0.5, 1.0, 0.2)
    row = spark.range(1).select(*[v.alias(k) for k, v in move.items()]).first()
    assert abs(row.vx - 0.25) < 1e-9 and abs(row.vy) < 1e-9 and row.wz == 0


def test_annotations_are_checked(spark):
    schema = "episode_uid string, split_lines array<struct<p0:struct<r:int,c:int>,p1:struct<r:int,c:int>,width_cells:int>>, merge_groups array<struct<component_ids:array<int>>>, review struct<status:string>"
    good = ("a", [((0, 0), (3, 3), 1)], [([1, 2],)], ("approved",))
    bad = ("b", [((0, 0), (9, 3), 1), ((1, 1), (1, 1), 0)], [([2, 2],)], None)
    got = navigation.annotation_problems(spark.createDataFrame([good, bad], schema), 5, 5).collect()
    assert {(r.episode_uid, r.problem) for r in got} == {("b", p) for p in ("line_outside_map", "line_without_length", "line_without_width", "group_of_one", "not_approved")}


def test_instances_by_overlap_then_distance(spark):
    schema = "scene int, step int, detection_id int, category string, box array<double>"
    box = lambda x: [float(v) for v in (x, 0, 0, x + 1, 1, 1)]
    rows = [(0, 0, 1, "chair", box(0)), (0, 1, 2, "chair", box(0.5)), (0, 1, 3, "table", box(0)), (0, 2, 4, "chair", box(9))]
    got = machines.in_batch(spark.createDataFrame(rows, schema), ["scene"], "step", machines.fused_instances, machines.OUTPUTS["fused_instances"])
    assert [(r.instance_id, r.category, r["count"]) for r in got.where("step = 2").orderBy("instance_id").collect()] == [(1, "chair", 2), (2, "table", 1), (3, "chair", 1)]


def test_doors_join_rooms(spark):
    schema = "scene int, step int, room_id int, cells array<struct<r:int,c:int>>, doors array<int>"
    left, right = [(0, c) for c in range(5)], [(0, c) for c in range(6, 12)]
    rows = [(0, 0, 1, left, [7]), (0, 1, 2, right, [7, 8]), (0, 2, 1, left, [7])]
    got = machines.in_batch(spark.createDataFrame(rows, schema), ["scene"], "step", machines.topology_map, machines.OUTPUTS["topology_map"]).orderBy("step").collect()
    assert [(r.node_id, r.nodes, r.edges, r.next_door, r.moved) for r in got] == [(1, 1, 0, 7, False), (2, 2, 1, 8, True), (1, 2, 1, 8, True)]


def test_subgraphs_and_choices(spark):
    nodes = spark.createDataFrame([(0, 1, "object", 10, None), (0, 2, "object", None, 20), (0, 10, "room", None, None)], "frame int, node_id int, kind string, room_id int, group_id int")
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 10)], "frame int, a int, b int")
    got = {r.center: (r.members, [tuple(e) for e in r.edges]) for r in graph.subgraphs(nodes, edges, ["frame"]).collect()}
    assert got[1] == ([1, 2, 10], [(1, 2), (1, 10)]) and got[2] == ([1, 2, 20], [(1, 2)])
    found = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.5)], "frame int, label int, distance double")
    assert [r.label for r in frontier.ranked(found, ["frame"], 0.4).collect()] == [2]
    assert [r.label for r in frontier.ranked(found, ["frame"], 9.0).orderBy("rank").collect()] == [1, 2]


def test_nearest_within_a_radius_is_strict(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "query_id int, x double, y double")
    p = spark.createDataFrame([(5, 1.0, 0.0), (4, 0.0, -0.5), (3, 0.5, 0.0)], "point_id int, x double, y double")
    assert matching.nearest(q, p.where("point_id = 5"), 1.0).count() == 0
    assert matching.nearest(q, p, 1.0).first().point_id == 3


def test_cut_cells_lie_between_the_walls(spark):
    line = spark.createDataFrame([(0, 1, i, 0, i) for i in range(8)], "frame int, candidate_id int, pos int, r int, c int")
    at = lambda *cs: spark.createDataFrame([(0, 0, c) for c in cs], "frame int, r int, c int")
    cut = lambda unknown: sorted(r.c for r in doors.partition_cut(line, ["frame"], at(1, 6), at(2, 3, 5), unknown, 2).collect())
    assert cut(1) == [2, 3, 4, 5] and cut(0) == [2, 3, 5]


def test_two_level_means_differ_from_pooled_ones(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 1.0, True), ("b", 0.0, True), ("b", 5.0, False)], "episode string, miou double, valid boolean")
    row = labels.episode_first(rows, ["episode"], ["miou"])[1].first()
    assert row.miou == 0.5 and abs(row.pooled_miou - 2 / 3) < 1e-9


def test_runs_are_evaluated_at_their_last_step(spark):
    steps = spark.createDataFrame([(1, i, 0.25 * i, 0.0, i == 2, 2.0 - 0.25 * i) for i in range(6)] + [(2, 0, 0.0, 0.0, False, 3.0), (2, 1, 9.0, 0.0, False, 0.5)], "ep int, step int, x double, y double, collided boolean, distance double")
    runs = spark.createDataFrame([(1, 1.0, 1.0, True, None), (2, 3.0, 1.0, True, "stuck"), (3, 2.0, 1.0, True, None)], "ep int, shortest double, success_distance double, stop_called boolean, failure_reason string")
    got = {r.ep: r for r in navigation.evaluated(steps, runs, ["ep"]).collect()}
    assert (got[1].steps, got[1].collisions, got[1].path_length, got[1].distance_to_goal, got[1].success, got[1].spl) == (6, 1, 1.25, 0.75, True, 0.8)
    assert (got[2].path_length, got[2].success, got[2].spl) == (0.0, False, 0.0) and abs(got[2].softspl - 2.5 / 3) < 1e-9
    assert (got[3].steps, got[3].distance_to_goal, got[3].success, got[3].softspl) == (0, float("inf"), False, 0.0)


def test_goals_merge_in_the_order_of_ids(spark):
    import random

    draw = random.Random(3)
    rows = [(0, i, draw.uniform(-9, 9), draw.uniform(-9, 9), draw.randint(0, 3)) for i in range(200)]
    kept: list = []
    for _, i, x, y, n in rows:
        near = [(((g[1] - x) ** 2 + (g[2] - y) ** 2) ** 0.5, j) for j, g in enumerate(kept)]
        d, j = min(near, default=(9.0, 0))
        n = max(1, n)
        if d >= 2.0:
            kept.append((i, x, y, n, 1))
        else:
            g = kept[j]
            kept[j] = (g[0], (g[1] * g[3] + x * n) / (g[3] + n), (g[2] * g[3] + y * n) / (g[3] + n), g[3] + n, g[4] + 1)
    df = spark.createDataFrame(rows, "scene int, node_id long, x double, y double, observed int")
    got = sorted(tuple(r)[1:] for r in navigation.merged_goals(df, ["scene"], 2.0).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [(g[0], g[3], g[4]) for g in kept]
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, kept))
    assert navigation.merged_goals(df.limit(0), ["scene"], 2.0).count() == 0


def test_nodes_become_rooms(spark):
    domain = spark.createDataFrame([(0, 0, c) for c in range(7)] + [(0, 2, 0)], "scene int, r int, c int")
    masks = spark.createDataFrame([(0, 5, 0, 1), (0, 3, 0, 1), (0, 9, 0, 5), (0, 9, 1, 5)], "scene int, node_id int, r int, c int")
    got = {(r.r, r.c): r.label for r in grids.rooms_of_nodes(masks, domain, ["scene"], 3, 7).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 2, (0, 6): 2}
