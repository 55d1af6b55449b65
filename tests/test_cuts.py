"""Skeletons keep their parts and holes; cuts part the ground as a flood a cut would."""

from collections import deque

import numpy as np

from gridloom.operators import cuts, raster
from gridloom.operators.cuts import CutRules

STEPS4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
STEPS8 = raster.square(1)


def parts(mask, steps):
    """Labels by a plain flood."""
    out, n = np.zeros(mask.shape, int), 0
    for start in map(tuple, np.argwhere(mask)):
        if out[start]:
            continue
        n += 1
        out[start], queue = n, deque([start])
        while queue:
            r, c = queue.popleft()
            for dr, dc in steps:
                a, b = r + dr, c + dc
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    queue.append((a, b))
    return out, n


def table(spark, masks):
    rows = [(f, int(r), int(c)) for f, m in enumerate(masks) for r, c in np.argwhere(m)]
    return spark.createDataFrame(rows, "frame int, r int, c int")


def test_thinning_keeps_parts_and_holes(spark):
    rng = np.random.default_rng(4)
    masks = []
    for k in range(8):
        m = np.zeros((22, 30), bool)
        for _ in range(int(rng.integers(3, 9))):
            r, c, h, w = rng.integers(0, 18), rng.integers(0, 24), rng.integers(1, 7), rng.integers(1, 12)
            m[r : r + h, c : c + w] = True
        if k % 2:
            m &= rng.random(m.shape) < 0.9
        masks.append(m)
    masks.append(np.pad(np.ones((2, 2), bool), 10))
    thin = [np.zeros_like(m) for m in masks]
    for x in cuts.thinned(table(spark, masks), ["frame"]).collect():
        thin[x.frame][x.r, x.c] = True
    for m, t in zip(masks, thin):
        assert not (t & ~m).any() and t.sum() < m.sum() or m.sum() == t.sum()
        assert parts(t, STEPS8)[1] == parts(m, STEPS8)[1]
        assert parts(np.pad(~t, 1, constant_values=True), STEPS4)[1] == parts(np.pad(~m, 1, constant_values=True), STEPS4)[1]
    band = np.zeros((9, 30), bool)
    band[2:7, 2:28] = True
    found = {(x.r, x.c) for x in cuts.thinned(table(spark, [band]), ["frame"]).collect()}
    assert len({r for r, c in found if 6 < c < 24}) == 1 and {c for _, c in found} >= set(range(6, 24))


def flooded(free, unknown, cut):
    """Gain and sides of one cut made alone, by two floods."""
    cut = cut & free
    after, n = parts(free & ~cut, STEPS4)
    near = lambda m: np.logical_or.reduce([m, *(raster_shift(m, r, c) for r, c in STEPS4)])
    sides = []
    for k in np.unique(after[near(cut) & (after > 0)]):
        side = after == k
        ring = near(side) & ~side
        r, c = np.nonzero(side)
        sides.append((int(side.sum()), int(r.min()), int(r.max()), int(c.min()), int(c.max()), int((ring & cut).sum()), int(ring.sum()), int((ring & unknown).sum())))
    return n - parts(free, STEPS4)[1], sorted(sides, key=lambda s: (-s[0], s[1], s[3]))


def raster_shift(mask, dr, dc):
    out = np.zeros_like(mask)
    h, w = mask.shape
    out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = mask[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
    return out


def test_all_cuts_at_once_are_one_flood_a_cut(spark):
    rng = np.random.default_rng(6)
    frees, darks, lines, want = [], [], [], {}
    for f in range(5):
        free = np.zeros((18, 26), bool)
        for _ in range(7):
            r, c = rng.integers(0, 15), rng.integers(0, 20)
            free[r : r + int(rng.integers(1, 6)), c : c + int(rng.integers(2, 12))] = True
        dark = ~free & (rng.random(free.shape) < 0.4)
        frees.append(free)
        darks.append(dark)
        for k in range(9):
            cut = np.zeros_like(free)
            r, c, n = int(rng.integers(0, 18)), int(rng.integers(0, 26)), int(rng.integers(1, 9))
            if k % 2:
                cut[r : r + n, c] = True
            else:
                cut[r, c : c + n] = True
            if k == 8:
                cut |= np.roll(cut, (5, 7), (0, 1))  # in two places
            lines += [(f, k, int(a), int(b)) for a, b in np.argwhere(cut)]
            if (cut & free).any():
                want[f, k] = flooded(free, dark, cut)
    line_table = spark.createDataFrame(lines, "frame int, cut_id int, r int, c int")
    got = cuts.sides_of_cuts(table(spark, frees), table(spark, darks), line_table, ["frame"], 18, 26)
    found = {(x.frame, x.cut_id): (x.gain, [(s.area, s.r0, s.r1, s.c0, s.c1, s.contact, s.ring, s.unknown) for s in x.sides]) for x in got.collect()}
    assert found == want and max(g for g, _ in want.values()) > 0


def test_verdicts(spark):
    side = lambda area, box, contact, ring, unknown: (area, *box, contact, ring, unknown)
    room, closet, sliver = side(3000, (0, 49, 0, 59), 4, 200, 10), side(200, (0, 9, 60, 79), 4, 60, 3), side(6, (0, 0, 60, 65), 2, 14, 9)
    hall = side(900, (0, 2, 60, 359), 3, 600, 300)
    shape = "cut_id int, gain int, sides array<struct<area:long,r0:int,r1:int,c0:int,c1:int,contact:long,ring:long,unknown:long>>"
    rows = [(1, 0, [room]), (2, 0, [room, hall]), (3, 1, [room]), (4, 1, [room, closet]), (5, 1, [room, sliver]), (6, 1, [room, hall]), (7, -1, []), (8, 1, [room, hall, closet])]
    got = {x.cut_id: x for x in cuts.cut_verdicts(spark.createDataFrame(rows, shape), [], CutRules()).collect()}
    assert {k: x.reason for k, x in got.items()} == {1: "reject_no_topology_gain", 2: "reject_no_topology_gain", 3: "reject_no_two_sides", 4: "reject_small_known_side_low_unknown", 5: "reject_split_tiny_side_width_1_to_3_cells", 6: "accepted", 7: "reject_no_topology_gain", 8: "accepted"}
    assert (got[6].small_area, got[6].small_width, got[6].unknown_ratio) == (900, 3, 0.05) and got[7].small_area is None
