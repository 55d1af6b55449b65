"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid of
cells; every distinct vector lives in the cell of its two nearest codewords. A
vector visits cells in the order of the multi-sequence algorithm (by the sum
of both squared distances): the first `visits` ones hold a (sum rank) staircase
of both sorted lists, so one partial sort of the staircase gives them. How
many to visit is measured when the index is fitted: partners at exactly the
threshold, in random directions and in directions between vectors, are placed,
and the rank by which `recall` of them is met is taken (closer partners are
met earlier). A pair of two cells is met where the vector of the lower cell
visits the higher one, so it is met once; whoever meets is verified in double
precision. The index is fitted on a bounded sample and holds every vector.

Copies and large groups: equal vectors are one entry with a count. Groups of
near copies that are a fixed share of all rows show in the sample; their
densest vectors become pivots. Vectors within half the link angle of a pivot are its ball: any two of
them link by the triangle inequality, so they are counted, not compared.
Another vector links to all of a ball or to none wherever its angle to the
pivot decides it, and visits the ball's members only where it does not. All
vectors meet all pivots (at most a sixteenth of the sample), so no link of a
ball rests on the grid. Cells and balls are cut into blocks of BLOCK homes and
VISITORS visitors, so a task holds one block pair; links leave it as
counts and as one edge per vector. Dense groups that are no ball and fill one cell
are still compared block by block, by the square of the cell.

Nulls: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different lengths. A null id
takes part: its row has the smallest other id of its component, or null.
Rows with equal ids each appear. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch
from .common import sampled, sized_broadcast, stash
from .components import components

SAMPLE_ROWS = 16_384
SAMPLE_COMPONENTS = 4_000_000
OCCUPANCY = 64
MOST_CODEWORDS = 1024
LEAST_BALL = 16
BLOCK = 1024
VISITORS = 8192
#: Slack of angles, far above the rounding of cosines.
SLACK = 1e-6
ROWS = 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1, keepdims=True) - 2 * (x @ codes.T) + (codes * codes).sum(1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = _squares(x, codes).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        some = count > 0
        codes[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some]) / count[some][:, None]
    return codes


class Grid:
    """Codebooks, visits and pivots of the vectors of one length."""

    def __init__(self, length: int, x: np.ndarray, rows: float, cosine: float, recall: float, first_ball: int):
        rng = np.random.default_rng(length)
        self.length, self.cut, self.angle = length, (length + 1) // 2, math.acos(cosine)
        self.cell0, self.first_ball = length << 40, first_ball
        inside = math.cos(self.angle / 2 - SLACK)
        self.pivots, loose = self._dense(x, inside)
        x = x[loose]
        self.k = max(1, min(MOST_CODEWORDS, len(x) // 8, int(math.sqrt(rows * loose.mean() / OCCUPANCY))))
        if len(x) == 0 or length < 2:
            self.k, self.visits = 1, 1
            self.left = self.right = None
            return
        self.left, self.right = _codebook(x[:, : self.cut].copy(), self.k, rng), _codebook(x[:, self.cut :].copy(), self.k, rng)
        self.visits = self._calibrated(x, cosine, recall, rng)

    @staticmethod
    def _dense(x: np.ndarray, inside: float) -> tuple[np.ndarray, np.ndarray]:
        alive, picked = np.ones(len(x), bool), []
        count = np.concatenate([(x[i : i + 1024] @ x.T >= inside).sum(1) for i in range(0, len(x), 1024)])
        while count.max(initial=0) >= LEAST_BALL:
            best = x[count.argmax()]
            gone = np.flatnonzero(alive & (x @ best >= inside))
            picked.append(best)
            alive[gone] = False
            for i in range(0, len(gone), 1024):
                count -= (x @ x[gone[i : i + 1024]].T >= inside).sum(1)
            count[~alive] = 0
        return np.array(picked).reshape(-1, x.shape[1]), alive

    def _calibrated(self, x: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> int:
        if self.k == 1:
            return 1
        near = x[rng.choice(len(x), min(len(x), 1024), replace=False)]
        way = rng.standard_normal(near.shape)
        way[::2] = x[rng.integers(0, len(x), len(way[::2]))]
        way -= (way * near).sum(1, keepdims=True) * near
        size = np.sqrt((way * way).sum(1, keepdims=True))
        partner = cosine * near + math.sqrt(1 - cosine * cosine) * way / np.where(size > 1e-9, size, 1)
        du, dv = self._distances(near)
        pu, pv = self._distances(partner)
        rows = np.arange(len(near))
        goal = du[rows, pu.argmin(1)] + dv[rows, pv.argmin(1)]
        ordered = np.sort(dv, 1)
        rank = np.array([np.searchsorted(ordered[i], goal[i] - du[i]).sum() + 1 for i in rows])
        return int(min(self.k**2, np.quantile(rank, recall, method="higher")))

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.cut], self.left), _squares(x[:, self.cut :], self.right)

    def home(self, x: np.ndarray) -> np.ndarray:
        if self.k == 1:
            return np.full(len(x), self.cell0)
        du, dv = self._distances(x)
        return self.cell0 + du.argmin(1) * self.k + dv.argmin(1)

    def visited(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the visits to cells above the home cell, by multi-sequence traversal."""
        if self.visits == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = [(a, b) for a in range(min(self.k, self.visits)) for b in range(min(self.k, self.visits // (a + 1)))]
        a, b = np.array(places).T
        rows, cells = [], []
        step = max(1, 4_000_000 // len(a))
        for at in range(0, len(x), step):
            du, dv = self._distances(x[at : at + step])
            su, sv = np.argsort(du, 1), np.argsort(dv, 1)
            sums = np.take_along_axis(du, su, 1)[:, a] + np.take_along_axis(dv, sv, 1)[:, b]
            first = np.argpartition(sums, self.visits - 1, 1)[:, : self.visits] if self.visits < len(a) else np.broadcast_to(np.arange(len(a)), sums.shape)
            cell = self.cell0 + np.take_along_axis(su, a[first], 1) * self.k + np.take_along_axis(sv, b[first], 1)
            row, col = np.nonzero(cell > home[at : at + step, None])
            rows.append(row + at)
            cells.append(cell[row, col])
        return np.concatenate(rows), np.concatenate(cells)

    def against_balls(self, x: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a vector surely links to all of a ball of a higher number than its own; whether it is undecided."""
        far = np.arccos(np.clip(x @ self.pivots.T, -1, 1))
        other = np.arange(len(self.pivots)) + self.first_ball > ball[:, None]
        every = other & (far <= self.angle / 2 - SLACK)
        return every, other & ~every & (far <= self.angle * 1.5 + SLACK)


def fitted(sample: list[list[float]], rows: int, cosine: float, recall: float) -> dict[int, Grid]:
    """A grid for each length in the sample; vectors of other lengths share a cell by length."""
    lengths, grids, balls = {}, {}, 0
    for x in sample:
        lengths.setdefault(len(x), []).append(x)
    for length, xs in sorted(lengths.items()):
        grid = Grid(length, unit(np.unique(np.array(xs, np.float64), axis=0)), rows * len(xs) / len(sample), cosine, recall, balls)
        balls += len(grid.pivots)
        grids[length] = grid
    return grids


def _by_length(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid]):
    """Rows of one length at a time: the batch, its unit vectors and its grid (None if the sample had none)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(part.schema.get_field_index("x"))
            sizes = np.asarray(x.value_lengths())
            for length in np.unique(sizes):
                rows = part if (sizes == length).all() else part.filter(pa.array(sizes == length))
                flat = rows.column(rows.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
                yield rows, unit(flat.reshape(-1, length).astype(np.float64)), grids.get(int(length))


def _ints(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _place(grids: dict[int, Grid]):
    """Adds ball (-1: none) and cell (a ball's: below zero)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, grid in _by_length(batches, grids):
            ball = np.full(len(x), -1)
            cell = grid.home(x) if grid else np.full(len(x), x.shape[1] << 40)
            if grid and len(grid.pivots):
                far = np.arccos(np.clip(x @ grid.pivots.T, -1, 1)) <= grid.angle / 2 - SLACK
                ball = np.where(far.any(1), far.argmax(1) + grid.first_ball, -1)
                cell = np.where(ball >= 0, -1 - ball, cell)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball, pa.int64()), pa.array(cell, pa.int64())], [*part.schema.names, "ball", "cell"])

    return run


def _visits(part: pa.RecordBatch, x: np.ndarray, grid: Grid | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all visits: grid cells for vectors of no ball, undecided balls for all."""
    if grid is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ball, cell = _ints(part, "ball"), _ints(part, "cell")
    loose = np.flatnonzero(ball < 0)
    rows, cells = grid.visited(x[loose], cell[loose])
    rows = loose[rows]
    if len(grid.pivots):
        row, b = np.nonzero(grid.against_balls(x, ball)[1])
        rows, cells = np.concatenate([rows, row]), np.concatenate([cells, -1 - (b + grid.first_ball)])
    return rows, cells


def _tally(grids: dict[int, Grid]):
    """(cell, homes, visits, size): rows of distinct vectors at home, visits, original rows at home; added up in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, grid in _by_length(batches, grids):
            home, n = _ints(part, "cell"), _ints(part, "n")
            cells = _visits(part, x, grid)[1]
            every, at = np.unique(np.concatenate([home, cells]), return_inverse=True)
            count = lambda places, w=None: pa.array(np.bincount(places, w, len(every)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(every), count(at[: len(home)]), count(at[len(home) :]), count(at[: len(home)], n)], ["cell", "homes", "visits", "size"])

    return run


def _certain(grids: dict[int, Grid], sizes: dict[int, int]):
    """(key, ball, links): of each vector its links to whole balls, by ball; of each ball (null key) what its members get from those vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, grid in _by_length(batches, grids):
            if grid is None or not len(grid.pivots):
                continue
            ball, n, key = _ints(part, "ball"), _ints(part, "n"), part.column(part.schema.get_field_index("key"))
            row, b = np.nonzero(grid.against_balls(x, ball)[0])
            b = b + grid.first_ball
            size = np.array([sizes.get(i, 0) for i in b.tolist()], np.int64)
            row, b, size = row[size > 0], b[size > 0], size[size > 0]
            mine = np.flatnonzero(ball >= 0)
            own = np.array([sizes[i] for i in ball[mine].tolist()], np.int64) - n[mine]
            met, at = np.unique(b, return_inverse=True)
            gets = np.bincount(at, n[row], len(met)).astype(np.int64)
            keys = pa.concat_arrays([key.take(pa.array(np.concatenate([row, mine]))), pa.nulls(len(met), key.type)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([b, ball[mine], met]).astype(np.int64)), pa.array(np.concatenate([size, own, gets]))], ["key", "ball", "links"])

    return run


def _sent(grids: dict[int, Grid]):
    """(cell, home, key, n, x): each vector at home and at its visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, grid in _by_length(batches, grids):
            names = ["key", "n", "x"]
            rows, cells = _visits(part, x, grid)
            for take, cell, home in [(np.arange(len(x)), _ints(part, "cell"), True), *((rows[i : i + 8192], cells[i : i + 8192], False) for i in range(0, len(rows), 8192))]:
                taken = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array([home] * len(take)), *(taken.column(taken.schema.get_field_index(c)) for c in names)], ["cell", "home", *names])

    return run


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether cosines of unit vectors reach the threshold; those within rounding of it are worked out one by one."""
    found = a @ b.T
    out = found >= cosine
    for i, j in np.argwhere(np.abs(found - cosine) < 1e-13):
        out[i, j] = math.fsum(a[i] * b[j]) >= cosine
    return out


def _meet(cosine: float):
    """Links within one block: (key, root, links) of each vector that has any, root being a vector of its group of links here."""
    def run(block: pa.Table) -> pa.Table:
        n = block.column("n").to_numpy()
        x = unit(block.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1).astype(np.float64))
        home = block.column("home").to_numpy()
        h, v = np.flatnonzero(home), np.flatnonzero(~home)
        pairs = []
        if len(h) and block.column("inside")[0].as_py():
            i, j = np.nonzero(np.triu(_linked(x[h], x[h], cosine), 1))
            pairs.append((h[i], h[j]))
        for at in range(0, len(v), 1024):
            part = v[at : at + 1024]
            i, j = np.nonzero(_linked(x[part], x[h], cosine))
            pairs.append((part[i], h[j]))
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        links = (np.bincount(a, n[b], len(n)) + np.bincount(b, n[a], len(n))).astype(np.int64)
        root = np.arange(len(n))
        while len(a):
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = pa.array(np.flatnonzero(links))
        key = block.column("key").combine_chunks()
        return pa.table({"key": key.take(some), "root": key.take(pa.array(root).take(some)), "links": pa.array(links).take(some)})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.99) -> DataFrame:
    """(id, n_links, component_id, kept): other rows with a cosine of at least `cosine`, and the smallest id reachable by links."""
    with scratch() as keep:
        return keep(stash(_near(df, id_col, vec_col, cosine, recall), "near-vectors"))


def _near(df: DataFrame, id_col: str, vec_col: str, cosine: float, recall: float) -> DataFrame:
    raw = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce((F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = raw.select("*", F.when(valid, F.xxhash64("x")).alias("h1"), F.when(valid, F.xxhash64(F.lit(1), "x")).alias("h2"))
    some = rows.where("h1 is not null").select("x")
    total, mean = some.agg(F.count("*"), F.avg(F.size("x"))).first()
    if not total:
        return raw.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = sampled(some, int(max(64, min(SAMPLE_ROWS, SAMPLE_COMPONENTS / mean))), total).toArrow().column("x").to_pylist()
    grids = fitted(sample, total, cosine, recall)

    # key: smallest id first, null ids last, so the smallest node of a component has its smallest id
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id"))
    vectors = rows.where("h1 is not null").groupBy("h1", "h2").agg(first.alias("f"), F.count("*").alias("n"), F.first("x").alias("x"))
    vectors = vectors.select(F.struct("f.z", "f.id", "h1").alias("key"), "h1", "h2", "n", "x")
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    shape = ", ".join(f"{c} {k}" for c, k in kinds.items())
    placed = stash(vectors.mapInArrow(_place(grids), f"{shape}, ball long, cell long"), "placed")
    cells = placed.mapInArrow(_tally(grids), "cell long, homes long, visits long, size long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"), F.sum("size").alias("size"))
    cells = stash(cells.where("homes > 0"), "cells")
    sizes = {-1 - r.cell: r.size for r in cells.where("cell < 0").select("cell", "size").collect()}  # one row a pivot

    blocks = cells.where("(cell >= 0 and homes > 1) or visits > 0").selectExpr("cell", f"ceil(homes / {BLOCK}) as nb", "homes", "visits")
    blocks = stash(blocks.selectExpr("cell", "nb", f"greatest(1, ceil((visits + if(nb > 1 and cell >= 0, homes, 0)) / {VISITORS})) as nv"), "blocks")
    sent = placed.mapInArrow(_sent(grids), f"cell long, home boolean, key {kinds['key']}, n long, x {kinds['x']}").join(sized_broadcast(blocks, 1 << 20), "cell")
    sent = sent.withColumns({"rb": F.pmod(F.xxhash64("key"), "nb"), "vb": F.pmod(F.xxhash64(F.lit(2), "key"), "nv")})
    # a home stands in its block for every visitor block, and visits the later blocks of its own grid cell
    homes = "transform(sequence(0L, nv - 1), v -> struct(rb as rb, v as vb, true as home))"
    later = "if(rb + 1 < nb and cell >= 0, transform(sequence(rb + 1, nb - 1), b -> struct(b as rb, vb as vb, false as home)), array())"
    guest = "transform(sequence(0L, nb - 1), b -> struct(b as rb, vb as vb, false as home))"
    dealt = sent.selectExpr("cell", "key", "n", "x", f"explode(if(home, concat({homes}, {later}), {guest})) as to")
    dealt = dealt.selectExpr("cell", "to.rb", "to.vb", "to.home", "to.vb = 0 and cell >= 0 as inside", "key", "n", "x")
    met = dealt.groupBy("cell", "rb", "vb").applyInArrow(_meet(cosine), f"key {kinds['key']}, root {kinds['key']}, links long")
    found = stash(met, "met")

    id_kind = rows.schema["id"].dataType
    node = F.struct(F.lit(True).alias("z"), F.lit(None).cast(id_kind).alias("id"), (-1 - F.col("ball")).alias("h1"))
    sure = stash(placed.mapInArrow(_certain(grids, sizes), f"key {kinds['key']}, ball long, links long"), "certain")
    edges = found.select(F.col("key").alias("a"), F.col("root").alias("b")).union(sure.where("key is not null").select(F.col("key").alias("a"), node.alias("b")))
    roots = stash(components(edges), "roots").selectExpr("node as key", "root.id as root_id")
    links = found.select("key", "links").union(sure.where("key is not null").select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    gets = sure.where("key is null").groupBy("ball").agg(F.sum("links").alias("gets"))  # at most one row a pivot
    each = placed.select("key", "h1", "h2", "n", "ball").join(links, "key", "left").join(roots, "key", "left").join(F.broadcast(gets), "ball", "left")
    n_links = F.col("n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("gets", F.lit(0))
    each = each.select("h1", "h2", n_links.alias("n_links"), F.when(F.col("links").isNull(), F.col("key.id")).otherwise(F.col("root_id")).alias("component_id"))
    out = rows.join(each, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
