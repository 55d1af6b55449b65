"""A flat of two rooms and a corridor, voxel by voxel, to rooms and doors."""

import numpy as np

from gridloom.operators import rooms, voxels
from gridloom.operators.rooms import RoomRules
from gridloom.plans import registry

FREE, OCCUPIED = voxels.FREE, voxels.OCCUPIED
H, W, LAYERS = 30, 64, 50
#: Heights of 0.05 m: doors end at 2.0 m, the ceiling stands at 2.4 m.
RULES = RoomRules(layers=LAYERS, obstacle=(4, 30), free=(2, 30), seeds=voxels.DoorSeedRules(turn_min_m=1.0, extent_scale=0.5), least_room=20)


def flat():
    """Ground of two rooms side by side behind a wall with a door of nine cells, and another opening without a lintel."""
    ground = np.zeros((H, W), bool)
    ground[2:28, 2:30] = ground[2:28, 33:62] = True
    doors = np.zeros_like(ground)
    doors[10:19, 30:33] = True
    return ground, doors


def known(spark, maps):
    rows = []
    for k, (ground, doors) in enumerate(maps):
        for r in range(H):
            for c in range(W):
                if ground[r, c]:
                    rows += [(k, z, r, c, FREE, 1) for z in range(1, 46)]
                elif doors[r, c]:
                    rows += [(k, z, r, c, FREE, 1) for z in range(1, 36)] + [(k, z, r, c, OCCUPIED, 1) for z in range(36, 50)]
                elif ground[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].any() or doors[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].any():
                    rows += [(k, z, r, c, OCCUPIED, 1) for z in range(1, 50)]
    return spark.createDataFrame(rows, "frame int, z int, r int, c int, state int, seen int")


def test_a_door_parts_two_rooms(spark):
    ground, doors = flat()
    open_plan = ground | doors  # the same opening up to the ceiling is no door
    wall = np.zeros_like(doors)
    got = rooms.voxel_rooms(known(spark, [(ground, doors), (open_plan, wall)]), ["frame"], H, W, RULES)
    label = np.zeros((2, H, W), int)
    for x in got["rooms"].collect():
        label[x.frame, x.r, x.c] = x.label
    assert set(label[0][ground].tolist()) == {1, 2} and len(set(label[0][2:28, 2:30].ravel().tolist())) == 1 and label[0, 14, 5] != label[0, 14, 50]
    assert (label[0][ground | doors] > 0).all() and (label[0][~(ground | doors)] == 0).all()
    assert set(label[1][open_plan].tolist()) == {1}
    assert [(x.frame, x.reason) for x in got["doors"].collect()] == [(0, None)]
    seeds = {(x.r, x.c) for x in got["seeds"].collect()}
    assert seeds == set(map(tuple, np.argwhere(doors).tolist()))
    cells = {(x.r, x.c) for x in got["cuts"].collect()}
    assert {r for r, _ in cells} == set(range(10, 19)) and {c for _, c in cells} <= {30, 31, 32}


def test_rejected_doors_are_named(spark):
    ground, doors = flat()
    short = np.zeros_like(doors)
    short[10:14, 30:33] = True  # four by three cells: not a line
    got = rooms.voxel_rooms(known(spark, [(ground, short)]), ["frame"], H, W, RULES)
    assert [x.reason for x in got["doors"].collect()] == ["primitive_line_correlation_too_low"]
    assert {x.label for x in got["rooms"].collect()} == {1} and got["cuts"].collect() == []


def test_no_voxels_give_no_rooms(spark):
    none = spark.createDataFrame([], "frame int, z int, r int, c int, state int, seen int")
    assert all(df.collect() == [] for df in rooms.voxel_rooms(none, ["frame"], H, W, RULES).values())


def test_flats_of_the_query(spark, sf):
    """Whole flats by their kind of passage: a door or a hatch parts the rooms, an open one does not."""
    frames = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey div 1280 as frame").groupBy("frame").count().where("count = 1280")
    whole = sorted(x.frame for x in frames.collect())
    got = {}
    for x in registry.queries()["voxel_rooms"](spark, sf).collect():
        got.setdefault(x.frame, {})[x.r, x.c] = x.label
    for f in whole:
        left, right = got[f][9, 5], got[f][9, 50]
        assert (left != right) == (f % 3 != 2) and len(set(got[f].values())) == (2 if f % 3 != 2 else 1)
