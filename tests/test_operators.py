"""Single operators on small hand-made inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import coords, scalar
from gridloom.operators import grids, kernels, labels, matching, raster, runs, voxels
from gridloom.sources import files, sinks


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def cells_of(spark, mask, frame=0):
    return spark.createDataFrame([(frame, int(r), int(c)) for r, c in np.argwhere(mask)], "frame int, r int, c int")


def pairs(df):
    return {(r.r, r.c) for r in df.collect()}


def test_a_diagonal_ray_passes_three_voxels(spark):
    got = column(spark, voxels.traversed([F.lit(0.5), F.lit(0.5), F.lit(0.5)], [F.lit(0.5), F.lit(2.5), F.lit(2.5)]))
    assert [tuple(v) for v in got] == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("free, occupied, value, state", [(10, 1, 4, 2), (10, 0, -1, 1)])
def test_hits_win_and_misses_are_capped(spark, free, occupied, value, state):
    df = spark.createDataFrame([(1, 0, free, occupied)], "v int, step int, free int, occupied int")
    assert tuple(voxels.folded(df, ["v"]).first()) == (1, value, state)


def test_an_occupied_voxel_is_freed_late(spark):
    model = voxels.LogOdds(hit=0, occupied_at=5, release_at=-3)
    states = []
    for n in (1, 2, 3):
        df = spark.createDataFrame([(1, -1, 0, 3)] + [(1, s, 1, 0) for s in range(n)], "v int, step int, free int, occupied int")
        one = voxels.folded(df, ["v"], model=voxels.LogOdds(hit=1, most_hits=1, occupied_at=1, release_at=-2))
        states.append(one.first().state)
    assert states == [2, 2, 1] and model.release_at == -3


def test_neutral_keeps_the_known_state(spark):
    df = spark.createDataFrame([(1, 0, 0, 1)] + [(1, s, 1, 0) for s in range(1, 5)], "v int, step int, free int, occupied int")
    assert tuple(voxels.folded(df, ["v"]).first()) == (1, 0, 2)


@pytest.mark.parametrize("truth, found, rates", [(2, 1, (0.5, 0)), (2, 3, (0, 0.5)), (2, 2, (0, 0))])
def test_count_rates(spark, truth, found, rates):
    t, f = F.lit(truth), F.lit(found)
    assert (column(spark, scalar.under_segmentation(t, f)), column(spark, scalar.over_segmentation(t, f))) == rates


@pytest.mark.parametrize("gt, pred, miou, n_pred", [([1, 1, 2, 2], [1, 1, 2, 2], 1.0, 2), ([1, 1, 2, 2], [1, 1, 1, 1], 0.25, 1), ([1, 2], [0, 0], 0.0, 0)])
def test_matched_iou(spark, gt, pred, miou, n_pred):
    table = lambda v: spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(v)], "scene int, r int, c int, label int")
    row = labels.snapshot_metrics(table(gt), table(pred), ["scene"]).first()
    assert (row.miou, row.n_pred) == (miou, n_pred) and row.n_gt == 2
    assert row.usr == (1.0 if n_pred == 0 else 0.5 if n_pred == 1 else 0.0)


def test_assignment_against_all_permutations():
    from itertools import permutations

    rnd = np.random.default_rng(1)
    for _ in range(60):
        g = rnd.random((rnd.integers(1, 5), rnd.integers(1, 5))).round(1)
        small = g if g.shape[0] <= g.shape[1] else g.T
        best = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        got = labels.assignment(g)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == small.shape[0]
        assert math.isclose(sum(g[i, j] for i, j in got), best)


def test_area_limits():
    assert scalar.min_area_cells(0.3, 0.05) == 120 and scalar.min_area_cells(0, 0.05) == 0
    with pytest.raises(ValueError):
        scalar.min_area_cells(1, 0)


@pytest.mark.parametrize("final, step, status", [(20, 20, "exact"), (15, 10, "within_final"), (5, 10, "nearest_after_final"), (None, 20, "snapshot_only")])
def test_last_snapshot(spark, final, step, status):
    snapshots = spark.createDataFrame([("a", 10), ("a", 20)], "scene string, step int")
    reported = spark.createDataFrame([("a", final)], "scene string, final_step int")
    assert tuple(matching.last_snapshot(snapshots, reported, ["scene"]).first()) == ("a", step, status)


def test_raster_operators_agree_with_kernels(spark):
    rnd = np.random.default_rng(2)
    for density in (0.3, 0.6):
        mask, target = rnd.random((13, 17)) < density, rnd.random((13, 17)) < 0.05
        df = cells_of(spark, mask)
        grid = lambda d: {(int(r), int(c)) for r, c in np.argwhere(d)}
        assert pairs(raster.dilate(df, ["frame"], raster.disk(2), 13, 17)) == grid(kernels.grown(mask, raster.disk(2)))
        assert pairs(raster.erode(df, ["frame"], raster.CROSS, 13, 17)) == grid(kernels.shrunk(mask, raster.CROSS))
        for n, steps in ((4, kernels.STEPS4), (8, kernels.STEPS8)):
            want, _ = kernels.label(mask, steps)
            assert {(r.r, r.c): r.label for r in raster.components(df, ["frame"], 17, n).collect()} == {(int(r), int(c)): int(want[r, c]) for r, c in np.argwhere(mask)}
        want = kernels.squared_distance(target)
        got = {(r.r, r.c): r.d2 for r in raster.squared_distance(df, cells_of(spark, target), ["frame"], 20).collect()}
        assert got == {(int(r), int(c)): int(want[r, c]) for r, c in np.argwhere(mask)}


def test_kernels_against_plain_search():
    rnd = np.random.default_rng(3)
    free = rnd.random((9, 11)) < 0.7
    free[0, 0] = True
    d = kernels.distances(free, [(0, 0)])
    length, cells = kernels.path(free, (0, 0), [tuple(map(int, p)) for p in np.argwhere(np.isfinite(d) & (d > 3))][:3])
    assert math.isclose(length, d[cells[-1]]) and all(free[c] for c in cells)
    want = np.full(free.shape, np.inf)
    want[0, 0] = 0
    for _ in range(200):
        for r, c in np.argwhere(free):
            for nr, nc, s in kernels._steps_from(free, int(r), int(c), True):
                want[nr, nc] = min(want[nr, nc], want[r, c] + s)
    assert np.allclose(np.nan_to_num(want, posinf=-1), np.nan_to_num(d, posinf=-1))


ROOMS = {"watershed": {}, "erosion": {"least_cells": 6}, "morphological": {"low": 4, "high": 120}, "distance": {"low": 4, "high": 120}}


@pytest.mark.parametrize("method, parameters", ROOMS.items())
def test_two_rooms_and_a_corridor_are_two_rooms(spark, method, parameters):
    mask = np.zeros((14, 40), bool)
    mask[1:13, 1:15] = mask[1:13, 24:38] = mask[5:8, 15:24] = True
    got = grids.segmented(cells_of(spark, mask), ["frame"], 14, 40, method, **parameters).collect()
    by = {(r.r, r.c): r.label for r in got}
    assert by[(6, 4)] != by[(6, 34)] and {by[(r, c)] for r in range(3, 11) for c in range(3, 13)} == {by[(6, 4)]}
    assert method in ("watershed", "erosion") or set(by) == {(int(r), int(c)) for r, c in np.argwhere(mask)}


def drawn(*rows):
    return np.array([[".123456789".index(x) for x in row] for row in rows])


def test_erosion_opens_closes_and_keeps_cores():
    mask = np.zeros((9, 19), bool)
    mask[1:8, 1:8] = mask[1:8, 11:18] = mask[4, 8:11] = True
    # opening takes the corners and the middle of the corridor; closing gives back the corridor alone, whose ends still meet
    got = kernels.erosion_rooms(mask, least_cells=4, least_part=10)
    assert (got == drawn(
        "...................",
        "..11111.....22222..",
        ".1111111...2222222.",
        ".1111111...2222222.",
        ".11111111122222222.",
        ".1111111...2222222.",
        ".1111111...2222222.",
        "..11111.....22222..",
        "...................")).all()
    assert not kernels.erosion_rooms(mask, least_cells=4, least_part=100).any()


def test_erosion_splits_a_component_only_into_large_children():
    mask = np.zeros((9, 27), bool)
    mask[1:8, 1:10] = mask[1:8, 17:26] = mask[3:6, 10:17] = True
    two = kernels.erosion_rooms(mask, least_cells=5, least_part=10)
    assert two[4, 4] == 1 and two[4, 22] == 2 and set(np.unique(two)) == {0, 1, 2}
    one = kernels.erosion_rooms(mask, least_cells=200, least_part=10)
    assert set(np.unique(one)) == {0, 1} and set(np.unique(kernels.erosion_rooms(mask, least_cells=5, least_ratio=0.6, least_part=10))) == {0, 1}


def test_distance_takes_the_smallest_threshold_of_most_rooms_and_floods_from_the_middle():
    mask = np.zeros((9, 21), bool)
    mask[1:8, 1:9] = mask[1:8, 12:20] = mask[4, 9:12] = True
    got = kernels.distance_rooms(mask, 4, 60)
    assert (got[1:8, 1:9] == 1).all() and (got[1:8, 12:20] == 2).all() and got[4, 9] == 1 and got[4, 11] == 2 and got[4, 10] == 1
    # a part too thin to erode has no seed of its own threshold: its first cell is one
    mask[0, 20] = True
    thin = kernels.distance_rooms(mask, 4, 60)
    assert thin[0, 20] == 3 or thin[0, 20] == thin[1, 19]
    alone = np.zeros((3, 7), bool)
    alone[1, 1:6] = True
    assert kernels.distance_rooms(alone, 4, 60)[1].tolist() == [0, 1, 1, 1, 1, 1, 0]


def test_morphology_erodes_first_and_leaves_ground_without_seed():
    mask = np.zeros((9, 12), bool)
    mask[1:8, 1:8] = True
    mask[1, 10] = True
    got = kernels.morphological_rooms(mask, 20, 30)
    assert (got[1:8, 1:8] == 1).all() and got[1, 10] == 0
    assert not kernels.morphological_rooms(mask, 26, 48).any()  # 49 cells are never tested, 25 come next


def test_metrics_in_one_pass_are_those_of_prepared_maps(spark):
    rnd = np.random.default_rng(5)
    for least in (0, 2, 5):
        maps = [rnd.integers(0, 9, (6, 11)) for _ in range(2)]
        truth, found = (spark.createDataFrame([(0, r, c, int(m[r, c])) for r in range(6) for c in range(11) if m[r, c]], "scene int, r int, c int, label int") for m in maps)
        got = labels.snapshot_metrics(truth, found, ["scene"], least).first()
        if least > 1:
            truth, found = labels.prepared(truth, found, ["scene"], least)
        want = labels.matched(labels.contingency(truth, found, ["scene"]), ["scene"]).first()
        assert (got.n_gt, got.n_pred) == (want.n_gt, want.n_pred) and math.isclose(got.miou, want.miou)
        assert sorted((p.gt, round(p.iou, 9)) for p in got.pairs) == sorted((p.gt, round(p.iou, 9)) for p in want.pairs)


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([(0, 0, c) for c in (1, 2, 3, 6, 7, 12)], "frame int, r int, c int")
    assert {(r.first, r.last) for r in raster.row_runs(df, ["frame"]).collect()} == {(1, 3), (6, 7), (12, 12)}
    assert pairs(runs.filled_gaps(df, ["frame"], 2)) == {(0, c) for c in (1, 2, 3, 4, 5, 6, 7, 12)}
    forbidden = spark.createDataFrame([(0, 0, 4)], "frame int, r int, c int")
    assert pairs(runs.filled_gaps(df, ["frame"], 2, forbidden=forbidden)) == pairs(df)
    assert pairs(runs.long_run_cells(df, ["frame"], 3)) == {(0, 1), (0, 2), (0, 3)}


def test_first_fit_is_not_a_closure(spark):
    rows = [(0, 1, "horizontal", 0, 0, 4, 1.0), (0, 2, "horizontal", 0, 20, 24, 1.0), (0, 3, "horizontal", 1, 2, 22, 1.0)]
    df = spark.createDataFrame(rows, "frame int, run_id int, axis string, line int, first int, last int, confidence double")
    got = sorted((r.line, r.members) for r in runs.merged_first_fit(df, ["frame"], 1, 1, 1).collect())
    assert got == [(0.0, 1), (0.5, 2)]


def test_holes_off_the_border_are_filled(spark):
    mask = np.ones((5, 6), bool)
    mask[2, 2] = mask[0, 4] = False
    df = cells_of(spark, mask)
    assert pairs(raster.filled_holes(df, df, ["frame"], 5, 6, 3)) == pairs(df) | {(2, 2)}


def test_coordinates_round_trip(spark):
    frame = coords.MapFrame(0.05, -20, 20, 800, 800)
    for _ in range(20):
        r, c = random.randrange(800), random.randrange(800)
        x, y = coords.x_of(F.lit(c), frame), coords.y_of(F.lit(r), frame)
        assert (column(spark, coords.row_of(y, frame)), column(spark, coords.col_of(x, frame))) == (r, c)


def test_scores_with_unreachable_goals(spark):
    inf = F.lit(float("inf"))
    assert column(spark, scalar.spl(F.lit(True), inf, F.lit(1.0))) == 0 and column(spark, scalar.soft_spl(inf, F.lit(0.0), F.lit(2.0), F.lit(4.0))) == 0.5
    assert column(spark, scalar.json_object(F.lit('say {"a": {"b": 1}} now'))) == '{"a": {"b": 1}}'
    assert column(spark, scalar.truth_of(F.lit(" Yes "))) is True and column(spark, scalar.entropy(F.expr("map('a', 1.0D, 'b', 1.0D)"))) == pytest.approx(math.log(2))


def test_sources_and_sinks(spark, tmp_path):
    scene = tmp_path / "run" / "s1"
    scene.mkdir(parents=True)
    np.savez(scene / "roomseg_step_00010.npz", free=np.eye(3), final_label=np.arange(9).reshape(3, 3))
    np.savez(scene / "roomseg_step_00020.npz", free=np.zeros((2, 2)))
    listing = files.snapshot_listing(spark, str(tmp_path / "run")).collect()
    assert [(r.scene, r.step, r.source) for r in listing] == [("s1", 10, "filename"), ("s1", 20, "filename")]
    cells = files.snapshot_cells(spark, str(tmp_path / "run"), ["free", "final_label"])
    assert cells.count() == 13 and cells.where("step = 10").agg(F.sum("final_label")).first()[0] == 36
    assert cells.where("step = 20 and final_label is null").count() == 4
    sinks.write_snapshots(cells, str(tmp_path / "out"), ["free"])
    assert spark.read.parquet(str(tmp_path / "out")).where("step = 10 and free = 1").count() == 3
    (tmp_path / "results.jsonl").write_text('{"episode_id": "e1", "steps": 3}\nbroken\n\n{"episode_id": "e2", "steps": 9}\n')
    last = files.last_row(files.json_lines(spark, str(tmp_path / "results.jsonl"), "episode_id string, steps int")).first()
    assert (last.episode_id, last.steps, last.rows) == ("e2", 9, 2)
    (tmp_path / "rooms.json").write_text('[{"room_id": "r", "category": "hall", "polygon": [[0, 0], [4, 0], [4, 4]]}]')
    room = files.rooms(spark, str(tmp_path / "rooms.json")).select(scalar.polygon_area(F.col("points")).alias("a")).first()
    assert room.a == 8
    sinks.write_csv(spark.range(2).withColumn("extra", F.lit(1)), str(tmp_path / "csv"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id"]
    assert sinks.markdown(spark.range(1), ["id"]).endswith("| 0 |\n") and "<td>0</td>" in sinks.gallery(spark.range(1), ["id"])
    merged = files.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})
    assert files.setting(merged, "a.b") == 3 and files.setting(merged, "a.x", 7) == 7 and merged["a"]["c"] == 2


def test_records_suppress_over_all_steps_of_their_life(spark):
    rnd = np.random.default_rng(11)
    records = [(1, k, int(rnd.integers(0, 200)), float(rnd.integers(0, 30)), float(rnd.integers(0, 30)), int(rnd.integers(-3, 90))) for k in range(60)]
    fronts = [(1, k, int(rnd.integers(0, 300)), float(rnd.integers(0, 30)), float(rnd.integers(0, 30))) for k in range(400)]
    r = spark.createDataFrame([(*x[:5], x[2] + x[5]) for x in records], "one int, record_id int, step int, x double, y double, until_step int")
    f = spark.createDataFrame(fronts, "one int, frontier_id int, step int, x double, y double")
    got = {x.frontier_id for x in matching.suppressed(f, r, ["one"], 2.0).collect()}
    want = {i for _, i, t, x, y in fronts if not any(s <= t <= s + life and math.hypot(a - x, b - y) <= 2 for _, _, s, a, b, life in records)}
    assert got == want and 0 < len(got) < 400
