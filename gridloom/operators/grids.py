"""Frames as single grids: cell tables through kernels, one frame a task.

A frame is a bounded raster, so it fits a task; frames are what is dealt out.
Kernels run by a name, so other segmenters can be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from . import kernels, partition

Segmenter = Callable[[np.ndarray], np.ndarray]


def grid_of(pdf: pd.DataFrame, height: int, width: int, column: str | None = None) -> np.ndarray:
    out = np.zeros((height, width), bool if column is None else float)
    out[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = True if column is None else pdf[column].to_numpy()
    return out


SEGMENTERS: dict[str, Callable[..., np.ndarray]] = {
    "components": lambda free, least=1: _large(kernels.label(free)[0], least),
    "watershed": kernels.watershed,
    "erosion": kernels.erosion_rooms,
    "morphological": kernels.morphological_rooms,
    "distance": kernels.distance_rooms,
}
#: Segmenters of whole tables.
TABLE_SEGMENTERS: dict[str, Callable[..., DataFrame]] = {"voronoi": partition.voronoi_rooms}


def _large(labels: np.ndarray, least: int) -> np.ndarray:
    """Labels of enough cells, numbered anew; the largest alone where none has."""
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    good = np.flatnonzero(sizes >= max(1, least))
    if not len(good) and sizes.any():
        good = np.array([int(np.argmax(sizes))])
    return np.where(np.isin(labels, good), np.searchsorted(good, labels) + 1, 0)


def register(name: str, segmenter: Callable[..., np.ndarray]) -> None:
    SEGMENTERS[name] = segmenter


def _schema(df: DataFrame, keys: list[str], *more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), *more])


def segmented(free: DataFrame, keys: list[str], height: int, width: int, method: str, **parameters) -> DataFrame:
    """(keys, r, c, label) by a registered segmenter, of the whole table or frame by frame.

    watershed: a component of one room is split at a bottleneck with least_side (4) cells on both sides.
    """
    if method in TABLE_SEGMENTERS:
        return TABLE_SEGMENTERS[method](free, keys, height, width, **parameters)
    segment, least_side = SEGMENTERS[method], parameters.pop("least_side", 4) if method == "watershed" else None

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = segment(grid_of(pdf, height, width), **parameters)
        r, c = np.nonzero(labels)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(r) for k in keys}, "r": r, "c": c, "label": labels[r, c].astype(int)})

    found = free.groupBy(*keys).applyInPandas(work, _schema(free, keys, "r int", "c int", "label int"))
    # written, as halving reads the labels several times and each would flood all frames again
    return found if least_side is None else partition.with_single_rooms_halved(cut(found, "labels"), keys, width, least_side)


def distance_field(free: DataFrame, sources: DataFrame, keys: list[str], height: int, width: int, diagonal: bool = True, penalty: str | None = None) -> DataFrame:
    """(keys, r, c, distance) to the nearest source of the frame; cells without a way have no row."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in [*keys, "r", "c", "distance"]})
        weight = None if penalty is None else grid_of(left, height, width, penalty)
        d = kernels.distances(grid_of(left, height, width), list(zip(right["r"], right["c"])), diagonal, weight)
        r, c = np.nonzero(np.isfinite(d))
        return pd.DataFrame({**{k: [v] * len(r) for k, v in zip(keys, key)}, "r": r, "c": c, "distance": d[r, c]})

    return free.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInPandas(work, _schema(free, keys, "r int", "c int", "distance double"))


def paths(free: DataFrame, tasks: DataFrame, keys: list[str], height: int, width: int, penalty: str | None = None) -> DataFrame:
    """(keys, task_id, length, cells) from each task's start to its nearest goal. tasks: (keys, task_id, start, goals), cells as (r, c)."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        grid = grid_of(left, height, width)
        weight = None if penalty is None else grid_of(left, height, width, penalty)
        rows = []
        for t in right.itertuples():
            length, cells = kernels.path(grid, (t.start["r"], t.start["c"]), [(g["r"], g["c"]) for g in t.goals], weight)
            rows.append((*key, t.task_id, length, [{"r": a, "c": b} for a, b in cells]))
        return pd.DataFrame(rows, columns=[*keys, "task_id", "length", "cells"])

    return free.groupBy(*keys).cogroup(tasks.groupBy(*keys)).applyInPandas(work, _schema(free, keys, "task_id long", "length double", "cells array<struct<r:int,c:int>>"))


def _flat(cuts: DataFrame, width: int) -> DataFrame:
    """Cells as places in raster order: numbers reach a task as one array, records would each be an object."""
    return cuts.withColumn("cells", F.transform("cells", lambda p: (p["r"] * width + p["c"]).cast("long")))


def cuts_accepted(free: DataFrame, candidates: DataFrame, keys: list[str], height: int, width: int, least_side: int = 1, most_cells: int = 10_000) -> DataFrame:
    """(keys, candidate_id, accepted): candidates (keys, candidate_id, score, cells) by falling score against the grid as cut so far."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = right.sort_values(["score", "candidate_id"], ascending=[False, True])
        cells = [np.stack(divmod(c, width), axis=1) for c in order["cells"]]
        ok = kernels.accepted_cuts(grid_of(left, height, width), cells, least_side, most_cells)
        return pd.DataFrame([(*key, i, a) for i, a in zip(order["candidate_id"], ok)], columns=[*keys, "candidate_id", "accepted"])

    return free.groupBy(*keys).cogroup(_flat(candidates, width).groupBy(*keys)).applyInPandas(work, _schema(free, keys, "candidate_id long", "accepted boolean"))


def cuts_closed(free: DataFrame, cuts: DataFrame, keys: list[str], height: int, width: int, most_gap: int = 1) -> DataFrame:
    """(keys, candidate_id, closed, reason) of ordered cuts, each by itself."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        grid = grid_of(left, height, width)
        found = kernels.closed_cuts(grid, [np.stack(divmod(c, width), axis=1) for c in right["cells"]], most_gap)
        return pd.DataFrame([(*key, i, *f) for i, f in zip(right["candidate_id"], found)], columns=[*keys, "candidate_id", "closed", "reason"])

    return free.groupBy(*keys).cogroup(_flat(cuts, width).groupBy(*keys)).applyInPandas(work, _schema(free, keys, "candidate_id long", "closed boolean", "reason string"))


def truth_from_annotation(domain: DataFrame, lines: DataFrame, keys: list[str], height: int, width: int, least: int = 1) -> DataFrame:
    """(keys, r, c, label): the domain cut by annotated lines, small parts and the lines' own cells given to the nearest room."""
    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        grid, lines_cut = grid_of(left, height, width), np.zeros((height, width), bool)
        for row in right.itertuples():
            n = max(abs(row.r1 - row.r0), abs(row.c1 - row.c0), 1)
            at = np.linspace(0, 1, n + 1)
            r, c = (np.rint(a + (b - a) * at).astype(int) for a, b in ((row.r0, row.r1), (row.c0, row.c1)))
            half = row.width // 2
            for dr in range(-half, row.width - half):
                for dc in range(-half, row.width - half):
                    inside = (r + dr >= 0) & (r + dr < height) & (c + dc >= 0) & (c + dc < width)
                    lines_cut[(r + dr)[inside], (c + dc)[inside]] = True
        labels, _ = kernels.label(grid & ~lines_cut)
        labels = kernels.nearest_fill(_large(labels, least), grid)
        r, c = np.nonzero(labels)
        return pd.DataFrame({**{k: [v] * len(r) for k, v in zip(keys, key)}, "r": r, "c": c, "label": labels[r, c].astype(int)})

    return domain.groupBy(*keys).cogroup(lines.groupBy(*keys)).applyInPandas(work, _schema(domain, keys, "r int", "c int", "label int"))


def rooms_of_nodes(masks: DataFrame, domain: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, r, c, label): a topology as rooms. A cell of the domain goes to the smallest node whose mask holds it, the rest to the node that reaches it first in 4-steps; nodes are numbered anew.

    masks: (keys, node_id, r, c), node_id from 1. Cells that no node reaches have no row.
    """
    claimed = masks.where("node_id > 0").groupBy(*keys, "r", "c").agg(F.min("node_id").cast("int").alias("node"))
    rows = domain.select(*keys, "r", "c").distinct().join(claimed, [*keys, "r", "c"], "left").fillna(0, ["node"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = kernels.in_order(kernels.flood(grid_of(pdf, height, width, "node").astype(np.int32), grid_of(pdf, height, width), kernels.STEPS4))
        r, c = np.nonzero(labels)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(r) for k in keys}, "r": r, "c": c, "label": labels[r, c].astype(int)})

    return rows.groupBy(*keys).applyInPandas(work, _schema(domain, keys, "r int", "c int", "label int"))


def seed_lines(seeds: DataFrame, keys: list[str], group: str, tolerance: float = 1.0) -> DataFrame:
    """(keys, group, score, r, c, on_line): the cells of each seed group and whether its best line takes them."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        score, inside = kernels.best_line(pdf[["r", "c"]].to_numpy(), 1009 + int(pdf[group].iloc[0]), tolerance)
        return pdf[[*keys, group, "r", "c"]].assign(score=score, on_line=inside)

    kinds = dict(seeds.dtypes)
    return seeds.groupBy(*keys, group).applyInPandas(work, _schema(seeds, keys, f"{group} {kinds[group]}", "r int", "c int", "score double", "on_line boolean"))
