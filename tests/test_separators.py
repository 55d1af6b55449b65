"""Gaps between facing runs, doors by patterns, shortest ways and targets: known cases, and plain Python on random input."""

import heapq
import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import routes, separators
from gridloom.operators.separators import GapRules


def kinds_of(length, free, unknown, support):
    """The kinds of one gap, rule by rule."""
    clip, out, r = lambda x: max(0.0, min(1.0, x)), {}, GapRules()
    if length <= r.physical_gap + r.tolerance and support >= r.physical_support and (length < r.door_least or free <= 0.8 or unknown >= 0.15):
        out["physical_wall_completion"] = clip(0.75 + 0.2 * support + 0.05 * unknown)
    if length <= r.missed_gap + r.tolerance and (length < r.door_least or free <= r.missed_free) and unknown <= r.missed_unknown:
        out["missed_scan_gap_closure"] = clip(0.65 + 0.25 * support + 0.1 * (1 - free))
    if length <= r.unknown_gap and unknown >= r.unknown_least:
        out["short_unknown_gap_closure"] = clip(0.55 + 0.35 * unknown + 0.1 * support)
    if r.door_least <= length <= r.door_most and support >= r.door_support and free >= r.door_free:
        middle = (r.door_least + r.door_most) / 2
        out["doorway_virtual_cut"] = clip(0.6 + 0.3 * free + 0.1 * (1 - min(1, abs(length - middle) / middle)))
    return out


def test_facing_gaps_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    runs, run_id = [], 0
    for frame in range(3):
        for _ in range(60):
            first = int(rng.integers(0, 180))
            runs.append((frame, run_id, ["horizontal", "vertical"][int(rng.integers(0, 2))], int(rng.integers(0, 30)), first, first + int(rng.integers(0, 12)), float(rng.integers(1, 9)) / 8))
            run_id += 1
    free = {(f, r, c) for f in range(3) for r in range(200) for c in range(200) if (r * 7 + c * 3 + f) % 5 < 3}
    unknown = {(f, r, c) for f in range(3) for r in range(200) for c in range(200) if (r * 5 + c + f) % 7 < 3}
    want = {}
    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            low, high = sorted((a, b), key=lambda x: x[4])
            if a[0] != b[0] or a[2] != b[2] or abs(a[3] - b[3]) > 4 or high[4] - low[5] - 1 < 1:
                continue
            line, first, last = round((a[3] + b[3]) / 2), low[5] + 1, high[4] - 1
            cells = [(a[0], line, x) if a[2] == "horizontal" else (a[0], x, line) for x in range(first, last + 1)]
            shares = [sum(c in s for c in cells) / len(cells) for s in (free, unknown)]
            for kind, score in kinds_of(len(cells) * 0.05, *shares, min(a[6], b[6])).items():
                want.setdefault((a[0], kind, a[2], line, first, last), round(score, 9))
    cells = lambda s: spark.createDataFrame(sorted(s), "frame int, r int, c int")
    table = spark.createDataFrame(runs, "frame int, run_id int, axis string, line int, first int, last int, confidence double")
    got = separators.facing_gaps(table, cells(free), cells(unknown), ["frame"], 200, 200)
    assert {(x.frame, x.kind, x.axis, x.line, x.first, x.last): round(x.confidence, 9) for x in got.collect()} == want and len({k[1] for k in want}) == 4


def test_only_near_runs_meet(spark):
    """One long row of short runs a gap apart: the join's rows grow with the runs, not with their pairs."""
    def met(n):
        runs = spark.range(n).selectExpr("1 as frame", "id as run_id", "'horizontal' as axis", "3 as line", "id * 40 as first", "id * 40 + 20 as last", "1D as confidence")
        none = spark.createDataFrame([], "frame int, r int, c int")
        free = spark.range(40 * n).selectExpr("1 as frame", "3 as r", "id as c")
        return separators.facing_gaps(runs, free, none, ["frame"], 10, 40 * n).select("runs").distinct().count()

    assert met(50) == 49 and met(200) == 199


def drawn(spark, *rows):
    """F free, O occupied, X both, U unknown; spaces have no row."""
    cells = [(0, r, c, x in "FX", x in "OX", x == "U") for r, row in enumerate(rows) for c, x in enumerate(row) if x != " "]
    return spark.createDataFrame(cells, "frame int, r int, c int, free boolean, occupied boolean, unknown boolean")


def test_pattern_doors(spark):
    #            b  tail  gap  short below none turn X
    cells = drawn(
        spark,
        "UOU OFU ",
        " OFOOFU ",
        "OOOOOFO ",
        "OOOOUFO ",
        "OOOXUFO ",
        "FFFFFFF ",
        "FFFFFFF ",
        "FFFFFOFO",
    )
    got = {x.c: (x.rule, x.free_cells, x.occupied_cells, x.unknown_cells, x.turn, x.reason_b, x.reason_a) for x in separators.pattern_doors(cells, ["frame"], (0, 0, 7, 6)).collect()}
    no_turn = "no_valid_turn_with_all_occupied_after"
    assert got == {
        0: ("free_occupied_unknown", 3, 3, 2, None, None, None),
        1: (None, 0, 0, 0, None, "unknown_tail_missing", no_turn),
        2: (None, 0, 0, 0, None, "unknown_tail_missing", no_turn),
        3: (None, 0, 0, 0, None, "occupied_run_too_short", no_turn),
        4: (None, 0, 0, 0, None, "unknown_below_occupied", "unknown_in_lower_free_run"),
        6: ("free_occupied_unknown", 3, 3, 2, None, None, None),
    }
    turned = drawn(spark, "OOOFO", "OOOFO", "UUUUF", "FOOOF", "OOOOF", "UUUUU")
    by = {x.c: (x.rule, x.turn, x.occupied_cells) for x in separators.pattern_doors(turned, ["frame"], (0, 0, 4, 4)).collect()}
    assert by == {4: (None, None, 0)}  # an unknown cell stands beside the last free one
    walls = drawn(spark, "OOOFO", "OOOOF", "OOOOF", "OOOOF")
    assert [(x.rule, x.turn, x.free_cells, x.occupied_cells, x.reason_b) for x in separators.pattern_doors(walls, ["frame"], (0, 0, 3, 4)).collect()] == [("free_turn_occupied", "left", 3, 4, "occupied_run_too_short")]


def dijkstra(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in out:
            out[n] = d
            for a, b, w in edges:
                if a == n and b not in out:
                    heapq.heappush(heap, (d + w, b))
    return out


def test_shortest_ways_are_those_of_dijkstra(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in range(6):
        n = 30
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 20, 60))]
        edges += [(k, k + 1, 0.5) for k in range(100, 100 + 3 * g)] + [(0, 100, 1.0)]
        rows += [(g, *e) for e in edges]
        want |= {(g, node): d for node, d in dijkstra(edges, 0).items()}
    odd = [(0, 0, 7, -1.0), (0, None, 7, 1.0), (0, 0, None, 1.0), (0, 0, 8, 0.0), (0, 0, 8, None)]
    edges = spark.createDataFrame(rows + odd, "g int, a int, b int, weight double")
    got = routes.shortest_ways(edges, spark.createDataFrame([(g, 0) for g in range(6)] * 2, "g int, node int"), ["g"]).collect()
    assert {(x.g, x.node): x.distance for x in got} == want
    best = {}
    for g, a, b, w in rows:
        best[g, a, b] = min(w, best.get((g, a, b), math.inf))
    for x in got:
        if x.node == 0:
            assert x.before is None
        else:
            assert x.before == min(a for (g, a, b), w in best.items() if g == x.g and b == x.node and (g, a) in want and want[g, a] + w == x.distance)
    none = spark.createDataFrame([], "g int, a int, b int, weight double")
    assert [tuple(x) for x in routes.shortest_ways(none, spark.createDataFrame([(1, 5)], "g int, node int"), ["g"]).collect()] == [(1, 5, 0.0, None)]


def test_targets_and_their_reasons(spark):
    agents = spark.createDataFrame([(k, 10, 10, k == 0) for k in range(6)] + [(6, 10, 10, None), (7, 10, 10, True)], "step int, r int, c int, escaped boolean")
    frontiers = spark.createDataFrame([(0, 50, 1.0, 1, 1), (1, 5, 9.0, 2, 2), (1, 9, 30.0, 3, 3), (1, 9, 20.0, 4, 4)], "step int, size int, distance double, r int, c int")
    nodes = spark.createDataFrame([(2, 1, "Unexplored", 10, 30), (2, 2, "Unexplored", 10, 15), (2, 3, "Explored", 10, 11), (3, 4, "Explored", 10, 12), (4, 5, "Unexplored", None, None), (5, 7, "Unexplored", 10, 12), (5, 6, "Unexplored", 12, 10)], "step int, node_id int, status string, r int, c int")
    waypoints = spark.createDataFrame([(0, 40, 40), (0, 10, 13), (1, 10, 11), (7, None, 3)], "step int, r int, c int")
    got = {x.step: (x.target_r, x.target_c, x.reason, x.done) for x in routes.next_targets(agents, frontiers, nodes, waypoints, ["step"]).orderBy(F.col("step")).collect()}
    done = (None, None, "done", True)
    assert got == {0: (10, 13, "escape", False), 1: (4, 4, "current_room_frontier", False), 2: (10, 15, "nearest_unexplored", False), 3: done, 4: done, 5: (12, 10, "nearest_unexplored", False), 6: done, 7: (None, None, "escape", True)}
