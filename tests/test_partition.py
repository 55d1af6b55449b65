"""Region graphs, bottlenecks and cuts from wall to wall, on small drawn maps and against plain Python."""

import threading

import numpy as np
import pytest

from gridloom.operators import grids, partition, raster
from gridloom.plans import storage


def table(spark, maps):
    """Label maps as (frame, r, c, label)."""
    rows = [(f, r, c, int(m[r, c])) for f, m in enumerate(maps) for r, c in np.argwhere(m > 0).tolist()]
    return spark.createDataFrame(rows, "frame int, r int, c int, label int")


def maps_of(df, maps):
    out = [np.zeros_like(m) for m in maps]
    for x in df.collect():
        out[x.frame][x.r, x.c] = x.label
    return out


def drawn(*rows):
    return np.array([[".123456789".index(x) for x in row] for row in rows])


def smallest_first(labels, force_below):
    """One merge at a time: the smallest region, to the neighbour with most border."""
    now = labels.copy()
    while True:
        sizes = {int(k): int((now == k).sum()) for k in np.unique(now[now > 0])}
        for k in sorted(sizes, key=lambda k: (sizes[k], k)):
            border = {}
            for r, c in np.argwhere(now == k).tolist():
                for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= a < now.shape[0] and 0 <= b < now.shape[1] and now[a, b] not in (0, k):
                        border[int(now[a, b])] = border.get(int(now[a, b]), 0) + 1
            if sizes[k] < force_below and border:
                now[now == k] = min(border, key=lambda j: (-border[j], j))
                break
        else:
            ranks = np.unique(now[now > 0])
            return np.where(now > 0, np.searchsorted(ranks, now) + 1, 0)


def test_rounds_of_merges_are_those_of_the_smallest_first(spark):
    rng = np.random.default_rng(2)
    maps = []
    for _ in range(12):
        seeds = rng.integers(0, 14, (int(rng.integers(3, 25)), 2))
        near = ((np.indices((14, 14)).transpose(1, 2, 0)[:, :, None] - seeds) ** 2).sum(3).argmin(2) + 1
        maps.append(np.where(rng.random((14, 14)) < 0.1, 0, near))
    got = maps_of(partition.merged_regions(table(spark, maps), ["frame"], 12), maps)
    for m, g in zip(maps, got):
        assert (g == smallest_first(m, 12)).all()


def test_small_rooms_go_to_the_neighbour_with_most_border(spark):
    maps = [drawn("111122222", "111322222", "111122222", "444......")]
    merge = lambda *a: maps_of(partition.merged_regions(table(spark, maps), ["frame"], *a), maps)[0]
    one = merge(2)
    assert one[1, 3] in (one[0, 0], one[0, 8]) and len(np.unique(one[one > 0])) == 3
    both = merge(4)
    assert both[3, 0] == both[0, 0] and len(np.unique(both[both > 0])) == 2
    assert (merge(0) == maps[0]).all()
    assert (merge(0, 4) == both).all()  # both share more than a fifth of their sides
    assert partition.merged_regions(table(spark, maps).where("false"), ["frame"], 4).collect() == []


def test_a_component_of_one_room_is_split_at_its_bottleneck(spark):
    mask = np.zeros((8, 20), int)
    mask[1:7, 1:8] = mask[1:7, 12:19] = mask[3:5, 8:12] = 1
    maps = [mask, np.pad(np.ones((3, 18), int), ((0, 5), (0, 2))), mask.T[:8, :].repeat(1, 0), np.where(mask, 1 + (np.arange(20) > 9), 0)]
    maps[2] = np.pad(mask.T, ((0, 0), (0, 12)))
    cells = table(spark, maps)
    at = {r.frame: (r.by_row, r.at) for r in partition.halved(cells.where("frame < 3"), ["frame"], 4).collect()}
    assert at == {0: (False, 9), 2: (True, 9)}
    assert partition.halved(cells, ["frame"], 60).where("frame = 0").collect() == []
    halves = maps_of(partition.with_single_rooms_halved(cells, ["frame"], 20, 4), maps)
    assert (halves[0][1:7, 1:8] == 1).all() and (halves[0][1:7, 12:19] == 2).all()
    assert set(halves[1][maps[1] > 0]) == {1} and (halves[3] == maps[3]).all()


def test_voronoi_cuts_between_walls_and_fills_the_ground(spark):
    mask = np.zeros((14, 40), int)
    mask[1:13, 1:15] = mask[1:13, 24:38] = mask[5:8, 15:24] = 1
    free = table(spark, [mask]).drop("label")
    rooms = lambda *a, **k: maps_of(grids.segmented(free, ["frame"], 14, 40, "voronoi", resolution=1.0, merge_below=a[0], force_below=a[1], low=3.0, stride=6, **k), [mask])[0]
    got = rooms(30.0, 6.0)
    assert ((got > 0) == (mask > 0)).all() and got[6, 4] != got[6, 34]
    assert len(np.unique(rooms(1e6, 1e6)[mask > 0])) == 1
    assert grids.segmented(free.where("false"), ["frame"], 14, 40, "voronoi").collect() == []


def test_facing_walls_and_their_lines(spark):
    points = spark.createDataFrame([(0, 5, 5, 4), (0, 20, 5, 4)], "frame int, r int, c int, d2 int")
    walls = spark.createDataFrame([(0, 3, 5), (0, 8, 5), (0, 5, 8), (0, 18, 5), (0, 20, 8)], "frame int, r int, c int")
    got = partition.facing_walls(points, walls, ["frame"], 8, 95.0).collect()
    assert [(x.r, tuple(x.u), tuple(x.v), x.angle) for x in got] == [(5, (3, 5), (8, 5), 180.0)]
    cells = partition.wall_to_wall(partition.facing_walls(points, walls, ["frame"], 8, 95.0), ["frame"], 0.5, 8)
    assert sorted((x.r, x.c) for x in cells.collect()) == [(r, 5) for r in range(3, 9)]


def test_ends_are_peeled_round_by_round(spark):
    """A ring keeps all its cells; a spur of four goes in four rounds, a closed end at a time."""
    ring = [(r, c) for r in range(6) for c in range(6) if r in (0, 5) or c in (0, 5)]
    spur = [(2, 5 + k) for k in range(1, 5)]
    cells = spark.createDataFrame([(0, *x) for x in ring + spur], "frame int, r int, c int")
    left = lambda n: {(x.r, x.c) for x in partition.pruned(cells, ["frame"], n).collect()}
    assert left(2) == set(ring + spur[:2]) and left(0) == set(ring + spur)
    assert set(ring) <= left(30) <= set(ring + spur[:1])  # a first cell beside three of the ring has three neighbours


def test_labels_fill_the_domain_step_by_step(spark):
    labels = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 6, 2), (1, 0, 0, 1)], "frame int, r int, c int, label int")
    domain = spark.createDataFrame([(f, 0, c) for f in (0, 1) for c in range(7)] + [(0, 9, 9)], "frame int, r int, c int")
    got = {(x.frame, x.r, x.c): x.label for x in partition.filled(labels, domain, ["frame"]).collect()}
    assert got == {(0, 0, c): 3 if c < 3 else 2 for c in range(7)} | {(1, 0, c): 1 for c in range(7)}


def test_two_threads_write_and_delete_their_own_tables(spark):
    found, failed = {}, []

    def work(k):
        try:
            with storage.scratch() as keep:
                for n in range(3):
                    df = storage.cut(spark.range(k * 100, k * 100 + 50 + n), f"t{k}")
                found[k] = keep(df).count()
            found[k] = df.count()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found == {k: 52 for k in range(4)}


@pytest.mark.parametrize("shape", [(9, 9), (16, 11)])
def test_the_ridge_is_where_no_neighbour_is_farther_from_walls(spark, shape):
    rng = np.random.default_rng(sum(shape))
    mask = np.pad(rng.random(shape) < 0.85, 1)
    free = spark.createDataFrame([(0, r, c) for r, c in np.argwhere(mask).tolist()], "frame int, r int, c int")
    distance, _ = partition.wall_distance(free, ["frame"], *mask.shape, 30)
    got = {(x.r, x.c) for x in partition.ridge(distance, ["frame"], 1.0).collect()}
    walls = np.argwhere(~mask)
    d2 = np.array([[((walls - (r, c)) ** 2).sum(1).min() if mask[r, c] else 0 for c in range(mask.shape[1])] for r in range(mask.shape[0])])
    want = {(r, c) for r, c in np.argwhere(mask).tolist() if d2[r, c] > 1 and d2[r, c] >= d2[r - 1 : r + 2, c - 1 : c + 2].max()}
    assert got == want and raster.disk(1)
