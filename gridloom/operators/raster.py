"""Raster operators on sparse cells: tables of (keys, r, c), one row a true cell.

A frame is one value of the key columns. Dilation and erosion move words of
64 cells of a row and never join cells with cells; other neighbourhoods are
exploded offset lists; components work on row runs, not on cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, release

Offsets = Sequence[tuple[int, int]]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)]


CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def offset_table(offsets: Offsets) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets]))


def within(height: int | Column, width: int | Column) -> Column:
    return (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < height) & (F.col("c") < width)


def spread(rows: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Spark's estimate of a table's size leaves out how often explode repeats a row, so a table of many cells passes for a small one."""
    return rows.hint("merge")


def tasks_of(rows: DataFrame, share: int, weight: Column | None = None) -> int:
    """As many tasks as the work of rows, counted here, asks for: one for each `share`. Spark deals by compressed bytes, and few bytes may become many cells."""
    work = rows.count() if weight is None else rows.agg(F.sum(weight)).first()[0] or 0
    return max(1, math.ceil(work / share))


def moved(cells: DataFrame, keys: list[str], offsets: Offsets, sign: int = 1) -> DataFrame:
    """Each cell at each offset, with repeats."""
    rows = cells.select(*keys, "r", "c", offset_table(offsets).alias("o"))
    return rows.select(*keys, (F.col("r") + sign * F.col("o.dr")).alias("r"), (F.col("c") + sign * F.col("o.dc")).alias("c"))


def words(cells: DataFrame, keys: list[str], name: str = "bits") -> DataFrame:
    """(keys, r, w, bits): the cells of a row in words of 64, bit c % 64 of word c div 64."""
    rows = cells.select(*keys, "r", F.expr("shiftright(cast(c as long), 6)").alias("w"), F.expr("shiftleft(1L, cast(c & 63 as int))").alias("bit"))
    return rows.groupBy(*keys, "r", "w").agg(F.bit_or("bit").alias(name))


def _cells(rows: DataFrame, keys: list[str], first: Column, kind: str) -> DataFrame:
    """The cells of words; first: the column of bit 0."""
    at = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)"))
    return rows.select(*keys, "r", first.alias("first"), at.alias("at")).select(*keys, "r", (F.col("first") + F.col("at")).cast(kind).alias("c"))


def _by_row(offsets: Offsets) -> dict[int, list[int]]:
    out: dict[int, set[int]] = {}
    for r, c in offsets:
        out.setdefault(r, set()).add(c)
    return {r: sorted(cs) for r, cs in sorted(out.items())}


def _signed(bits: int) -> int:
    """64 bits as a long."""
    return bits - (1 << 64) if bits >> 63 else bits


def dilate(cells: DataFrame, keys: list[str], offsets: Offsets, height: int | Column, width: int | Column) -> DataFrame:
    """A cell gives a word (two at a border of words) for each row of the offsets, so groups are words, not cells."""
    masks = [(r, k * 64, _signed(sum(1 << c - k * 64 for c in cs if c // 64 == k))) for r, cs in _by_row(offsets).items() for k in sorted({c // 64 for c in cs})]
    rows = cells.select(*keys, "r", F.col("c").cast("long").alias("c"), F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(k).alias("dc"), F.lit(m).cast("long").alias("m")) for r, k, m in masks])).alias("o"))
    rows = rows.select(*keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "o.m").select(*keys, "r", F.expr("shiftright(c, 6)").alias("w"), F.expr("cast(c & 63 as int)").alias("b"), "m")
    halves = F.expr("array(named_struct('w', w, 'bits', shiftleft(m, b)), named_struct('w', w + 1, 'bits', shiftrightunsigned(shiftrightunsigned(m, 63 - b), 1)))")
    rows = rows.select(*keys, "r", F.explode(halves).alias("x")).select(*keys, "r", "x.w", "x.bits").where("bits <> 0")
    grown = rows.groupBy(*keys, "r", "w").agg(F.bit_or("bits").alias("bits"))
    return _cells(grown, keys, F.col("w") * 64, dict(cells.dtypes)["c"]).where(within(height, width))


def eroded(cells: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """Cells all of whose neighbours are true, on a plane without borders.

    Words overlap by the reach along a row, so each has all it needs; rows meet by a count.
    """
    by_row = _by_row(offsets)
    reach = max(abs(c) for cs in by_row.values() for c in cs)
    if reach > 24:  # too far for a word
        votes = moved(cells.select(*keys, "r", "c").distinct(), keys, offsets, -1)
        return votes.groupBy(*keys, "r", "c").count().where(F.col("count") == len(set(offsets))).drop("count")
    own = 64 - 2 * reach
    blocks = F.explode(F.sequence(F.floor((F.col("c") - reach) / own), F.floor((F.col("c") + reach) / own)))
    rows = cells.where("c is not null").select(*keys, "r", "c", blocks.alias("w")).select(*keys, "r", "w", F.expr(f"shiftleft(1L, cast(c - w * {own} + {reach} as int))").alias("bit"))
    rows = rows.groupBy(*keys, "r", "w").agg(F.bit_or("bit").alias("bits"))
    shifted = lambda c: f"shiftrightunsigned(bits, {c})" if c >= 0 else f"shiftleft(bits, {-c})"
    mask = _signed(((1 << own) - 1) << reach)
    along = F.explode(F.expr("array(" + ", ".join(f"named_struct('dr', {r}, 'bits', {' & '.join(map(shifted, cs))} & {mask}L)" for r, cs in by_row.items()) + ")"))
    rows = rows.select(*keys, "r", "w", along.alias("x")).select(*keys, (F.col("r") - F.col("x.dr")).alias("r"), "w", "x.bits").where("bits <> 0")
    rows = rows.groupBy(*keys, "r", "w").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(by_row))
    return _cells(rows, keys, F.col("w") * own - reach, dict(cells.dtypes)["c"])


def erode(cells: DataFrame, keys: list[str], offsets: Offsets, height: int | Column, width: int | Column) -> DataFrame:
    """Cells all of whose neighbours are true; outside counts as false, so borders erode."""
    return eroded(cells, keys, offsets).where(within(height, width))


def close(cells: DataFrame, keys: list[str], offsets: Offsets, height: int, width: int) -> DataFrame:
    return erode(dilate(cells, keys, offsets, height, width), keys, offsets, height, width)


def open_(cells: DataFrame, keys: list[str], offsets: Offsets, height: int, width: int) -> DataFrame:
    return dilate(erode(cells, keys, offsets, height, width), keys, offsets, height, width)


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(spread(b.select(*keys, "r", "c").distinct()), [*keys, "r", "c"], "left_anti")


def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(spread(b.select(*keys, "r", "c").distinct()), [*keys, "r", "c"], "left_semi")


def inner_boundary(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return minus(cells, erode(cells, keys, CROSS, height, width), keys)


def whole(frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """All cells of each frame."""
    rows = frames.select(*keys).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def complement(cells: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    return minus(whole(frames, keys, height, width), cells, keys)


def row_runs(cells: DataFrame, keys: list[str], line: str = "r", along: str = "c") -> DataFrame:
    """(keys, line, first, last) of runs of neighbours along a line."""
    order = Window.partitionBy(*keys, line).orderBy(along)
    rows = cells.select(*keys, line, along).distinct().withColumn("island", F.col(along) - F.row_number().over(order))
    return rows.groupBy(*keys, line, "island").agg(F.min(along).alias("first"), F.max(along).alias("last")).drop("island")


def star_roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): the smallest node that each can reach, over edges (keys, a, b), by alternating stars."""
    def step(e: DataFrame, large: bool) -> DataFrame:
        both_ways = e.union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both_ways.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both_ways.join(spread(least), [*keys, "a"])
        out = joined.where("b > a" if large else "b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        return (out if large else out.union(least.where("a <> m").select(*keys, "a", F.col("m").alias("b")))).distinct()

    now, seen = cut(edges.select(*keys, "a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        half = cut(step(now, True), "large")
        release(now)
        now = cut(step(half, False), "small")
        release(half)
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def components(cells: DataFrame, keys: list[str], width: int, connectivity: int = 4) -> DataFrame:
    """(keys, r, c, label): labels count from 1 in the order of each component's first cell in raster order."""
    runs = cut(row_runs(cells, keys).withColumn("node", F.col("r").cast("long") * width + F.col("first")), "runs")
    slack = 1 if connectivity == 8 else 0
    below = runs.select(*keys, (F.col("r") - 1).alias("r"), F.col("first").alias("first_b"), F.col("last").alias("last_b"), F.col("node").alias("b"))
    touch = (F.col("first") <= F.col("last_b") + slack) & (F.col("first_b") <= F.col("last") + slack)
    edges = runs.withColumnRenamed("node", "a").join(spread(below), [*keys, "r"]).where(touch).select(*keys, "a", "b")
    roots = star_roots(edges, keys)
    named = runs.join(spread(roots), [*keys, "node"], "left").select(*keys, "r", "first", "last", F.coalesce("root", "node").alias("root"))
    numbers = named.select(*keys, "root").distinct()
    order = Window.partitionBy(*keys).orderBy("root") if keys else Window.orderBy("root")
    numbers = numbers.withColumn("label", F.row_number().over(order))
    return named.join(spread(numbers), [*keys, "root"]).select(*keys, "r", F.explode(F.sequence("first", "last")).alias("c"), "label")


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def without_small(cells: DataFrame, keys: list[str], width: int, least: int, connectivity: int = 4) -> DataFrame:
    labelled = components(cells, keys, width, connectivity)
    large = component_sizes(labelled, keys).where(F.col("area") >= least).select(*keys, "label")
    return labelled.join(spread(large), [*keys, "label"], "left_semi").select(*keys, "r", "c")


def filled_holes(cells: DataFrame, frames: DataFrame, keys: list[str], height: int, width: int, most: int, connectivity: int = 4) -> DataFrame:
    """cells with the components of the complement that stay off the border and have at most `most` cells."""
    outside = components(complement(cells, frames, keys, height, width), keys, width, connectivity)
    small = component_sizes(outside, keys).where((F.col("area") <= most) & (F.col("r0") > 0) & (F.col("c0") > 0) & (F.col("r1") < height - 1) & (F.col("c1") < width - 1))
    holes = outside.join(spread(small.select(*keys, "label")), [*keys, "label"], "left_semi").select(*keys, "r", "c")
    return cells.select(*keys, "r", "c").unionByName(holes).distinct()


def flooded(cells: DataFrame, seeds: DataFrame, keys: list[str], width: int, connectivity: int = 4) -> DataFrame:
    """The components that hold a seed."""
    labelled = components(cells, keys, width, connectivity)
    found = labelled.join(spread(seeds.select(*keys, "r", "c").distinct()), [*keys, "r", "c"], "left_semi").select(*keys, "label").distinct()
    return labelled.join(spread(found), [*keys, "label"], "left_semi").select(*keys, "r", "c")


def snapped(cells: DataFrame, seeds: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Each seed's nearest true cell within the radius, ties by row and column."""
    near = seeds.select(*keys, F.col("r").alias("seed_r"), F.col("c").alias("seed_c"), offset_table(disk(radius)).alias("o"))
    near = near.select("*", (F.col("seed_r") + F.col("o.dr")).alias("r"), (F.col("seed_c") + F.col("o.dc")).alias("c"), (F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc")).alias("d2"))
    hit = spread(near).join(cells.select(*keys, "r", "c").distinct(), [*keys, "r", "c"])
    best = hit.groupBy(*keys, "seed_r", "seed_c").agg(F.min(F.struct("d2", "r", "c")).alias("best"))
    return best.select(*keys, "seed_r", "seed_c", "best.r", "best.c", "best.d2")


def line_cells(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Cells of a straight line by even steps, each rounded half to even, as an array of (r, c)."""
    n = F.greatest(F.abs(r1 - r0), F.abs(c1 - c0))
    at = lambda a, b, i: F.rint(a + (b - a) * i / F.greatest(n, F.lit(1)).cast("double")).cast("int")
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.struct(at(r0, r1, i).alias("r"), at(c0, c1, i).alias("c")))


def bresenham_cells(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Integer line by its error term, as an ordered array of (r, c)."""
    dr, dc = F.abs(r1 - r0).cast("int"), F.abs(c1 - c0).cast("int")
    sr, sc = F.when(r0 < r1, 1).otherwise(-1), F.when(c0 < c1, 1).otherwise(-1)
    start = F.struct(r0.cast("int").alias("r"), c0.cast("int").alias("c"), (dc - dr).alias("e"), F.array(F.struct(r0.cast("int").alias("r"), c0.cast("int").alias("c"))).alias("cells"))

    def step(s, _):
        across, down = 2 * s["e"] >= -dr, 2 * s["e"] <= dc
        r, c = s["r"] + F.when(down, sr).otherwise(0), s["c"] + F.when(across, sc).otherwise(0)
        return F.struct(r.alias("r"), c.alias("c"), (s["e"] - F.when(across, dr).otherwise(0) + F.when(down, dc).otherwise(0)).alias("e"), F.array_append(s["cells"], F.struct(r.alias("r"), c.alias("c"))).alias("cells"))

    steps = F.greatest(dr, dc)
    return F.when(steps == 0, start["cells"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)["cells"])


def squared_distance(cells: DataFrame, targets: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, r, c, d2): exact squared distance of each cell to its nearest target within `reach` (null beyond).

    First the nearest target of each column to each row that has cells, by a window; then a
    row's cells take the least of g*g + (c - c')^2 over its columns. A frame gives
    at most its rows times its columns, whatever the reach.
    """
    column = targets.select(*keys, F.col("c").alias("tc"), F.col("r").alias("tr"))
    near = cells.select(*keys, "r", "c").distinct()
    rows = near.groupBy(*keys, "r").agg((F.min("c") - reach).alias("low"), (F.max("c") + reach).alias("high"))
    columns = column.select(*keys, "tc").distinct()
    probe = spread(rows).join(columns, keys) if keys else rows.crossJoin(columns)
    probe = probe.where("tc between low and high").select(*keys, "tc", "r", F.lit(None).cast("int").alias("tr"))
    events = probe.unionByName(column.select(*keys, "tc", F.col("tr").alias("r"), F.col("tr").cast("int").alias("tr")))
    order = Window.partitionBy(*keys, "tc").orderBy("r")
    up = F.last("tr", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    down = F.first("tr", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("r") - up, down - F.col("r"))
    best = events.withColumn("g", g).where(F.col("tr").isNull() & (F.col("g") <= reach))
    lines = best.groupBy(*keys, "r").agg(F.collect_list(F.struct("tc", "g")).alias("line"))
    d2 = F.array_min(F.transform("line", lambda x: (F.pow(F.col("c") - x["tc"], 2) + F.pow(x["g"], 2)).cast("long")))
    return near.join(spread(lines), [*keys, "r"], "left").select(*keys, "r", "c", F.when(d2 <= reach * reach, d2).alias("d2"))
