"""Cuts of free ground tried one by one, all at once: what each would part if it alone were made; and the skeleton of corridors.

A frame is a bounded raster and goes to one task (`kernels`); frames are what is dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, raster


def _raster(r: np.ndarray, c: np.ndarray, low: tuple[int, int], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[r - low[0], c - low[1]] = True
    return out


def thinned(cells: DataFrame, keys: list[str], rounds: int = 1000) -> DataFrame:
    """(keys, r, c): the skeleton of the cells, peeled from above, below, right and left in turn until nothing moves.

    Components (of eight neighbours) and holes are kept, and ends stay where they are. Rounds
    grow with half the width of the widest place.
    """
    rows = cells.select(*keys, "r", "c").distinct()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        low = (r.min(), c.min())
        left = kernels.thinned(_raster(r, c, low, (r.max() - low[0] + 1, c.max() - low[1] + 1)), rounds)
        return pdf[left[r - low[0], c - low[1]]]

    return rows.groupBy(*keys).applyInPandas(work, rows.schema)


def sides_of_cuts(free: DataFrame, unknown: DataFrame, cuts: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, cut_id, gain, sides): by cut, how many components it alone would add, and the parts it touches by falling area: area, box, contact cells, ring cells and those of them that are unknown.

    cuts: (keys, cut_id, r, c); their cells off the free ground do not count. A
    ring is the cells beside a part (of four neighbours) on the map, the cut's own ones too.
    """
    free = free.select(*keys, "r", "c").distinct()
    dark = unknown.select(*keys, "r", "c").where(raster.within(height, width))
    own = raster.both(cuts.select(*keys, "cut_id", "r", "c").distinct(), free, keys)
    cells = free.withColumn("free", F.lit(True)).unionByName(dark.withColumn("free", F.lit(False)))
    names = ("r0", "c0", "area", "r1", "c1", "contact", "ring", "unknown")

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right):
            r, c, on = left["r"].to_numpy(), left["c"].to_numpy(), left["free"].to_numpy()
            low = (min(0, r.min()), min(0, c.min()))
            shape = (max(height - 1, r.max()) - low[0] + 1, max(width - 1, c.max()) - low[1] + 1)
            on_map = np.zeros(shape, bool)
            on_map[-low[0] : height - low[0], -low[1] : width - low[1]] = True
            own = [(i, x[["r", "c"]].to_numpy() - low) for i, x in right.groupby("cut_id")]
            got = kernels.sides_of_cuts(_raster(r[on], c[on], low, shape), _raster(r[~on], c[~on], low, shape), on_map, [x for _, x in own])
            for (i, _), (gain, sides) in zip(own, got):
                rows.append((*key, i, gain, [dict(zip(names, (s[0] + low[0], s[1] + low[1], s[2], s[3] + low[0], s[4] + low[1], *s[5:]))) for s in sides]))
        return pd.DataFrame(rows, columns=[*keys, "cut_id", "gain", "sides"])

    kinds, kinds_of_place = dict(free.dtypes) | dict(cuts.dtypes), dict(free.dtypes)
    at = {n: kinds_of_place[n[0]] if n[0] in "rc" and n[1:] in "01" else "bigint" for n in names}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"cut_id {kinds['cut_id']}", "gain long", f"sides array<struct<{','.join(f'{n}:{at.get(n)}' for n in names)}>>"])
    return cells.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(work, schema)


@dataclass(frozen=True)
class CutRules:
    """Limits of the verdict on a corridor cut; fixed values of the method."""

    resolution: float = 0.05
    known_area: float = 2.00
    most_unknown: float = 0.20
    sliver_width: int = 2
    sliver_area: float = 0.03
    sliver_length: float = 0.35
    sliver_contact: int = 3


def cut_verdicts(sides: DataFrame, keys: list[str], rules: CutRules = CutRules()) -> DataFrame:
    """(keys, cut_id, accepted, reason, small_area, small_width, unknown_ratio) of cuts by their two largest sides.

    A cut has to add a component and touch two; none of the two may be a small
    part that is known all around, nor a sliver: narrow, small, short and touched by few cells.
    """
    cell = rules.resolution * rules.resolution
    main = F.slice("sides", 1, 2)
    wide = lambda s: F.least(s["r1"] - s["r0"], s["c1"] - s["c0"]) + 1
    long = lambda s: (F.greatest(s["r1"] - s["r0"], s["c1"] - s["c0"]) + 1) * rules.resolution
    dark = lambda s: F.when(s["ring"] > 0, s["unknown"] / s["ring"]).otherwise(0.0)
    known = F.exists(main, lambda s: (s["area"] * cell < rules.known_area) & (dark(s) <= rules.most_unknown))
    sliver = F.exists(main, lambda s: (wide(s) <= rules.sliver_width) & (s["area"] * cell < rules.sliver_area) & (long(s) < rules.sliver_length) & (s["contact"] <= rules.sliver_contact))
    reason = F.when(F.col("gain") <= 0, "reject_no_topology_gain").when(F.size("sides") < 2, "reject_no_two_sides").when(known, "reject_small_known_side_low_unknown").when(sliver, "reject_split_tiny_side_width_1_to_3_cells").otherwise("accepted")
    some = F.size("sides") > 0
    return sides.select(*keys, "cut_id", (reason == "accepted").alias("accepted"), reason.alias("reason"), F.when(some, F.try_element_at(main, F.lit(-1))["area"]).alias("small_area"), F.when(some, F.array_min(F.transform(main, wide))).alias("small_width"), F.when(some, F.array_min(F.transform(main, dark))).alias("unknown_ratio"))
