"""Sequential raster kernels on one grid, in numpy: what a frame's task runs where order or recursion is the semantics."""

from __future__ import annotations

import heapq
import math

import numpy as np

STEPS4 = ((-1, 0), (0, -1), (0, 1), (1, 0))
STEPS8 = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def shifted(mask: np.ndarray, dr: int, dc: int, fill=False) -> np.ndarray:
    """out[r, c] = mask[r - dr, c - dc]; `fill` outside."""
    out = np.full_like(mask, fill)
    h, w = mask.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = mask[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
    return out


def grown(mask: np.ndarray, offsets) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, r, c) for r, c in offsets])


def shrunk(mask: np.ndarray, offsets) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, -r, -c) for r, c in offsets])


def label(mask: np.ndarray, steps=STEPS4) -> tuple[np.ndarray, int]:
    """Components numbered by their first cell in raster order: least flat places spread until nothing moves."""
    h, w = mask.shape
    none = h * w
    place = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        low = np.minimum.reduce([place, *(shifted(place, r, c, none) for r, c in steps)])
        low[~mask] = none
        flat = np.append(low.ravel(), none)
        jumped = flat[flat[:-1]].reshape(h, w)  # each to the place of its place
        jumped[~mask] = none
        if (jumped == place).all():
            break
        place = jumped
    roots = np.unique(place[mask])
    return np.where(mask, np.searchsorted(roots, np.minimum(place, none - 1)) + 1, 0).astype(np.int32), len(roots)


def squared_distance(target: np.ndarray) -> np.ndarray:
    """Exact squared distance of each cell to the nearest target; inf without one. Columns first, then rows."""
    h, w = target.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(target, rows, -(10**6)), axis=0)
    down = np.minimum.accumulate(np.where(target, rows, 10**6)[::-1], axis=0)[::-1]
    g = np.minimum(rows - up, down - rows).astype(float)
    g2 = np.where(g < 10**5, g * g, np.inf)
    cols = np.arange(w)
    out = np.full((h, w), np.inf)
    for c in range(w):
        out = np.minimum(out, g2[:, c : c + 1] + (cols - c) ** 2)
    return out


def nearest_fill(labels: np.ndarray, domain: np.ndarray) -> np.ndarray:
    """Unlabelled cells of the domain get the label of the nearest labelled cell, the smallest at a tie."""
    best, out = np.full(labels.shape, np.inf), np.zeros_like(labels)
    for k in np.unique(labels[labels > 0]):
        d = squared_distance(labels == k)
        closer = d < best
        best[closer], out[closer] = d[closer], k
    return np.where(labels > 0, labels, np.where(domain, out, 0))


def wavefront(labels: np.ndarray, domain: np.ndarray, steps=STEPS8) -> np.ndarray:
    """Labels spread through the domain step by step, the smallest neighbouring label first."""
    now = np.where(domain, labels, 0)
    big = np.iinfo(now.dtype).max
    while True:
        near = np.minimum.reduce([np.where(s > 0, s, big) for s in (shifted(now, r, c, 0) for r, c in steps)])
        fresh = (now == 0) & domain & (near < big)
        if not fresh.any():
            return now
        now = np.where(fresh, near, now)


def distances(free: np.ndarray, sources: list[tuple[int, int]], diagonal: bool = True, weight: np.ndarray | None = None) -> np.ndarray:
    """Shortest path lengths in cells from any source; diagonals cost a root of two and cut no corners."""
    out = np.full(free.shape, np.inf)
    heap = []
    for r, c in sources:
        if free[r, c]:
            out[r, c] = 0.0
            heapq.heappush(heap, (0.0, r, c))
    for d, r, c, nr, nc in _relaxed(free, out, heap, diagonal, weight):
        del d, r, c, nr, nc
    return out


def _steps_from(free: np.ndarray, r: int, c: int, diagonal: bool):
    h, w = free.shape
    for dr, dc in STEPS8 if diagonal else STEPS4:
        nr, nc = r + dr, c + dc
        if 0 <= nr < h and 0 <= nc < w and free[nr, nc] and (not (dr and dc) or (free[r, nc] and free[nr, c])):
            yield nr, nc, math.sqrt(2) if dr and dc else 1.0


def _relaxed(free, out, heap, diagonal, weight):
    while heap:
        d, r, c = heapq.heappop(heap)
        if d > out[r, c]:
            continue
        for nr, nc, step in _steps_from(free, r, c, diagonal):
            nd = d + step * (1.0 if weight is None else 1.0 + weight[nr, nc])
            if nd < out[nr, nc] and np.isfinite(nd):
                out[nr, nc] = nd
                heapq.heappush(heap, (nd, nr, nc))
                yield nd, r, c, nr, nc


def path(free: np.ndarray, start: tuple[int, int], goals: list[tuple[int, int]], weight: np.ndarray | None = None) -> tuple[float, list[tuple[int, int]]]:
    """(length, cells) of a shortest path to the nearest goal; inf and none where there is no way."""
    out = np.full(free.shape, np.inf)
    if not free[start]:
        return math.inf, []
    out[start] = 0.0
    back = {}
    for _, r, c, nr, nc in _relaxed(free, out, [(0.0, *start)], True, weight):
        back[(nr, nc)] = (r, c)
    best = min(goals, key=lambda g: (out[g], g), default=None)
    if best is None or not np.isfinite(out[best]):
        return math.inf, []
    cells = [best]
    while cells[-1] != start:
        cells.append(back[cells[-1]])
    return float(out[best]), cells[::-1]


def flood(labels: np.ndarray, domain: np.ndarray, steps=STEPS8, height: np.ndarray | None = None) -> np.ndarray:
    """Labels spread through the domain from the highest cells down, cells of one height first come first; without heights, breadth first."""
    h, w = labels.shape
    wide = w + 2
    grid = np.pad(np.where(domain, labels, 0).astype(np.int32), 1)
    out = np.where(np.pad(domain, 1), grid, -1).ravel().tolist()  # a border that no label enters
    level = np.pad(np.zeros((h, w)) if height is None else -height, 1).ravel().tolist()
    moves = [r * wide + c for r, c in steps]
    heap = [(level[p], k, p) for k, p in enumerate(np.flatnonzero(grid > 0).tolist())]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, p = heapq.heappop(heap)
        for q in moves:
            q += p
            if out[q] == 0:
                out[q] = out[p]
                heapq.heappush(heap, (level[q], count, q))
                count += 1
    return np.maximum(np.array(out, np.int32).reshape(h + 2, wide)[1:-1, 1:-1], 0)


def in_order(labels: np.ndarray) -> np.ndarray:
    """Labels as 1..n in ascending order."""
    return np.where(labels > 0, np.searchsorted(np.unique(labels[labels > 0]), labels) + 1, 0).astype(np.int32)


def watershed(mask: np.ndarray, spacing: float = 4.0, least_peak: float = 1.0) -> np.ndarray:
    """Rooms by flooding from spaced peaks of the distance to the outside, highest first."""
    d2 = squared_distance(np.pad(~mask, 1, constant_values=True))[1:-1, 1:-1]
    d2 = np.where(mask, d2, 0)
    peak = mask & (d2 >= np.maximum.reduce([shifted(d2, r, c, 0) for r, c in STEPS8])) & (d2 >= least_peak)
    seeds: list[tuple[int, int]] = []
    pr, pc = np.nonzero(peak)
    reach = math.ceil(spacing)
    around = np.hypot(*np.mgrid[-reach : reach + 1, -reach : reach + 1]) < spacing
    taken = np.zeros((mask.shape[0] + 2 * reach, mask.shape[1] + 2 * reach), bool)
    for k in np.lexsort((pc, pr, -d2[pr, pc])).tolist():
        r, c = int(pr[k]), int(pc[k])
        if not taken[r + reach, c + reach]:
            seeds.append((r, c))
            taken[r : r + 2 * reach + 1, c : c + 2 * reach + 1] |= around
    labels = np.zeros(mask.shape, np.int32)
    for k, (r, c) in enumerate(sorted(seeds), 1):
        labels[r, c] = k
    labels = flood(labels, mask, STEPS4, d2)
    left, _ = label(mask & (labels == 0))
    labels = np.where(left > 0, left + labels.max(), labels)
    return labels


#: Order in which a room's cells claim their neighbours under erosion: sides first.
SIDES_FIRST = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))


def erosion_rooms(mask: np.ndarray, least_cells: int = 500, least_ratio: float = 0.02, rounds: int = 256, least_part: int = 40) -> np.ndarray:
    """Rooms by cores that outlive erosion, on the mask opened by a cross and closed by a square.

    A component (8 neighbours, least_part cells or more) is eroded by a cross;
    where two or more pieces of least_cells and of least_ratio of it are left,
    each is taken on its own, else its last cells before it vanishes are one
    core. Cores grow back breadth first over the cleaned mask.
    """
    cross, square = ((0, 0), *STEPS4), ((0, 0), *STEPS8)
    clean = shrunk(grown(grown(shrunk(mask, cross), cross), square), square)
    cores, k = np.zeros(mask.shape, np.int32), 0

    def pieces(cells: np.ndarray) -> list[np.ndarray]:
        found, n = label(cells, STEPS8)
        return [found == i for i in range(1, n + 1)]

    stack = [p for p in pieces(clean) if p.sum() >= least_part][::-1]
    while stack:
        part = stack.pop()
        area, core, children = int(part.sum()), part, []
        for _ in range(rounds):
            less = shrunk(core, cross)
            if not less.any():
                break
            children = [p for p in pieces(less) if p.sum() >= least_cells and p.sum() / max(1, area) >= least_ratio]
            if len(children) >= 2:
                break
            core = less
        if len(children) >= 2:
            stack += children[::-1]
        else:
            k += 1
            cores[core] = k
    return flood(cores, clean, SIDES_FIRST)


def morphological_rooms(free: np.ndarray, low: int, high: int, rounds: int = 200) -> np.ndarray:
    """Erode again and again; a component in the band of areas becomes a seed and leaves; seeds then spread. Ground without a seed has no room."""
    work, seeds, k = free.copy(), np.zeros(free.shape, np.int32), 0
    for _ in range(rounds):
        work = shrunk(work, ((0, 0), *STEPS8))
        parts, n = label(work, STEPS8)
        sizes = np.bincount(parts.ravel(), minlength=n + 1)
        for i in np.flatnonzero((sizes >= low) & (sizes <= high)):
            if i:
                k += 1
                seeds[parts == i] = k
                work = work & (parts != i)
        if not work.any():
            break
    return in_order(flood(seeds, free))


def distance_rooms(free: np.ndarray, low: int, high: int, erosions: int = 1) -> np.ndarray:
    """Seeds are the components of cells at a rounded distance or more from the edge of the eroded ground, at the distance that gives most of them in the band of areas, the smallest at a tie.

    A component of the ground without a seed gets one cell, the farthest from
    the edge; seeds flood the ground from the farthest cells down.
    """
    work = free
    for _ in range(erosions):
        work = shrunk(work, ((0, 0), *STEPS8))
    far = np.where(work, np.sqrt(squared_distance(~work)), 0).astype(np.float32)
    steps = np.clip(np.rint(far), 0, 255)
    most, seeds = -1, np.zeros(free.shape, np.int32)
    for t in np.unique(steps[work & (steps > 0)])[::-1]:
        parts, n = label(work & (steps >= t), STEPS8)
        sizes = np.bincount(parts.ravel(), minlength=n + 1)
        sizes[0] = 0
        good = (sizes >= low) & (sizes <= high) & (np.arange(n + 1) > 0)
        if good.sum() >= most:
            most, seeds = int(good.sum()), np.where(good[parts], np.cumsum(good)[parts], 0).astype(np.int32)
    parts, n = label(free, STEPS8)
    for i in range(1, n + 1):
        own = parts == i
        if not seeds[own].any():
            seeds.flat[np.argmax(np.where(own, far, -1))] = seeds.max() + 1
    return in_order(flood(seeds, free, STEPS8, far))


def _parts_beside(rest: int, own: int, wide: int, enough: int) -> tuple[list[int], int]:
    """The parts of `rest` that touch `own` (of eight neighbours), as numbers of a bit a cell, and how many parts `own` itself joins to one.

    The last part is followed only until it holds all that is left to reach and has `enough` cells: alone it parts nothing.
    """
    around = lambda x: x << 1 | x >> 1 | x << wide | x >> wide
    rows = own | own << 1 | own >> 1
    seeds, parts = (rows | rows << wide | rows >> wide) & rest, []
    while seeds:
        part = front = seeds & -seeds
        while front and (seeds & ~part or (parts and part.bit_count() < enough)):
            front = around(front) & rest & ~part
            part |= front
        seeds &= ~part
        parts.append(part)
    left, loose, joined = own, list(parts), 0
    while left:
        group, joined = left & -left, joined + 1
        while True:
            near = around(group)
            more = near & left
            for p in [p for p in loose if p & near]:
                more |= around(p) & left
                loose.remove(p)
            if not more & ~group:
                break
            group |= more
        left &= ~group
    return parts, joined


def _bits_at(cells: np.ndarray, wide: int) -> int:
    """Cells of a raster with an empty cell around, as a number of a bit a cell."""
    out = 0
    for at in ((cells[:, 0] + 1) * wide + cells[:, 1] + 1).tolist():
        out |= 1 << at
    return out


def accepted_cuts(free: np.ndarray, candidates: list[np.ndarray], least_side: int, most_cells: int) -> list[bool]:
    """Ordered cuts, each accepted if on what earlier ones left it splits a component into two or more sides that touch it and are large enough."""
    wide, out = free.shape[1] + 2, []
    now = _bits(np.pad(free, 1))
    for cells in candidates:
        own, ok = _bits_at(cells, wide) & now, False
        if 0 < own.bit_count() <= most_cells:
            parts, before = _parts_beside(now & ~own, own, wide, least_side)
            beside = own << 1 | own >> 1 | own << wide | own >> wide
            after = sum(1 for p in parts if p & beside)
            ok = after > before and len(parts) >= 2 and all(p.bit_count() >= least_side for p in parts)
        if ok:
            now &= ~own
        out.append(ok)
    return out


def closed_cuts(free: np.ndarray, cuts: list[np.ndarray], most_gap: int) -> list[tuple[bool, str]]:
    """Whether each ordered cut reaches from wall to wall and separates what it borders."""
    wide, padded = free.shape[1] + 2, np.pad(free, 1)
    near, ground, out = grown(~padded, [(r, c) for r in range(-most_gap, most_gap + 1) for c in range(-most_gap, most_gap + 1)]), _bits(padded), []
    for cells in cuts:
        if not len(cells):
            out.append((False, "empty_cut"))
        elif not (near[cells[0][0] + 1, cells[0][1] + 1] and near[cells[-1][0] + 1, cells[-1][1] + 1]):
            out.append((False, "open_end"))
        else:
            own = _bits_at(cells, wide)
            out.append((True, "closed") if len(_parts_beside(ground & ~own, own, wide, 1)[0]) >= 2 else (False, "one_side"))
    return out


def closes_wall_to_wall(free: np.ndarray, cells: np.ndarray, most_gap: int) -> tuple[bool, str]:
    """The same of one cut."""
    return closed_cuts(free, [cells], most_gap)[0]


def best_line(points: np.ndarray, seed: int, tolerance: float = 1.0, tries: int = 200) -> tuple[float, np.ndarray]:
    """(score, inlier flags) of the best line through two points: all pairs when few, seeded draws otherwise."""
    n = len(points)
    if n < 2:
        return 0.0, np.ones(n, bool)
    pairs = [(i, j) for i in range(n) for j in range(i)] if n <= 32 else [tuple(p) for p in np.random.default_rng(seed).integers(0, n, (tries, 2)) if p[0] != p[1]]
    best = (-np.inf, np.zeros(n, bool))
    for i, j in pairs:
        d = (points[i] - points[j]).astype(float)
        size = np.hypot(*d)
        if size == 0:
            continue
        off = np.abs((points - points[j]) @ np.array([-d[1], d[0]])) / size
        inside = off <= tolerance
        along = (points[inside] - points[j]) @ d / size
        score = inside.sum() + 0.3 * (along.max() - along.min()) - 0.5 * off[inside].mean()
        if score > best[0] + 1e-12:
            best = (float(score), inside)
    return best


#: Neighbours around a cell, clockwise from the one above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def thinned(mask: np.ndarray, rounds: int) -> np.ndarray:
    """The skeleton: cells open on one side that part nothing around them and are no ends go, from above, below, right and left in turn until nothing moves."""
    now = np.pad(mask, 1)
    for _ in range(rounds):
        before = now.sum()
        for side in (0, 4, 2, 6):
            near = [shifted(now, -r, -c) for r, c in RING]
            off = [~n for n in near]
            # how many separate pieces the neighbours form, for cells that touch at corners
            pieces = sum((off[k] & (near[k + 1] | near[(k + 2) % 8])).astype(np.int8) for k in (0, 2, 4, 6))
            now &= ~(off[side] & (pieces == 1) & (sum(n.astype(np.int8) for n in near) >= 2))
        if now.sum() == before:
            break
    return now[1:-1, 1:-1]


def _bits(mask: np.ndarray) -> int:
    """A raster as one number, a bit a cell."""
    return int.from_bytes(np.packbits(mask.ravel(), bitorder="little").tobytes(), "little")


def sides_of_cuts(free: np.ndarray, unknown: np.ndarray, on_map: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, list[tuple]]]:
    """By cut (row and column of its cells, all free): how many components it alone would add, and (r0, c0, area, r1, c1, contact, ring, unknown) of the parts it touches by falling area.

    Rasters are numbers of a bit a cell with an empty column and row around, so a step of a flood is four shifts.
    """
    free, unknown, on_map = (np.pad(x, 1) for x in (free, unknown, on_map))
    labels, n = label(free)
    shape, wide = free.shape, free.shape[1]
    parts = [_bits(labels == k) for k in range(1, n + 1)]
    rim_of_map, dark = _bits(on_map & ~free), _bits(unknown)
    around = lambda x: x << 1 | x >> 1 | x << wide | x >> wide
    out = []
    for cells in cuts:
        r, c = cells[:, 0] + 1, cells[:, 1] + 1
        own = 0
        for at in (r * wide + c).tolist():
            own |= 1 << at
        hit, sides = np.unique(labels[r, c]).tolist(), []
        beside = around(own) & ~own
        for k in hit:
            rest = parts[k - 1] & ~own
            seeds = beside & rest
            while seeds:
                part, grown = 0, seeds & -seeds
                while grown != part:
                    part, grown = grown, (grown | around(grown)) & rest
                seeds &= ~part
                edge = around(part)
                rim, contact = edge & rim_of_map, (edge & own).bit_count()
                grid = np.unpackbits(np.frombuffer(part.to_bytes((free.size + 7) // 8, "little"), np.uint8), bitorder="little")[: free.size].reshape(shape)
                rows, columns = np.flatnonzero(grid.any(1)), np.flatnonzero(grid.any(0))
                sides.append((int(rows[0]) - 1, int(columns[0]) - 1, part.bit_count(), int(rows[-1]) - 1, int(columns[-1]) - 1, contact, rim.bit_count() + contact, (rim & dark).bit_count()))
        out.append((len(sides) - len(hit), sorted(sides, key=lambda s: (-s[2], *s))))
    return out
