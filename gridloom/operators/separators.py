"""Cuts proposed from wall runs that face each other, and doors by patterns along scans of a map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from . import raster


@dataclass(frozen=True)
class GapRules:
    """Limits on gaps between wall runs, in metres and ratios; fixed values of the method."""

    resolution: float = 0.05
    most_lateral: float = 0.20
    physical_gap: float = 0.45
    physical_support: float = 0.35
    missed_gap: float = 0.45
    missed_unknown: float = 0.70
    missed_free: float = 0.65
    unknown_gap: float = 0.60
    unknown_least: float = 0.45
    door_least: float = 0.45
    door_most: float = 1.60
    door_support: float = 0.30
    door_free: float = 0.55
    tolerance: float = 0.051

    @property
    def most_cells(self) -> int:
        """No kind of gap is longer."""
        return int(max(self.physical_gap + self.tolerance, self.missed_gap + self.tolerance, self.unknown_gap, self.door_most) / self.resolution + 1e-9)


def _kinds(rules: GapRules) -> Column:
    """The kinds that a gap may be, with their confidence, as an array."""
    length, free, unknown, support = (F.col(c) for c in ("length_m", "free_ratio", "unknown_ratio", "wall_support"))
    narrow = length < rules.door_least
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    middle = 0.5 * (rules.door_least + rules.door_most)
    fit = 1.0 - F.least(F.lit(1.0), F.abs(length - middle) / middle)
    physical = (length <= rules.physical_gap + rules.tolerance) & (support >= rules.physical_support) & (narrow | (free <= 0.80) | (unknown >= 0.15))
    missed = (length <= rules.missed_gap + rules.tolerance) & (narrow | (free <= rules.missed_free)) & (unknown <= rules.missed_unknown)
    short = (length <= rules.unknown_gap) & (unknown >= rules.unknown_least)
    door = length.between(rules.door_least, rules.door_most) & (support >= rules.door_support) & (free >= rules.door_free)
    kinds = [
        (physical, "physical_wall_completion", 0.75 + 0.2 * support + 0.05 * unknown),
        (missed, "missed_scan_gap_closure", 0.65 + 0.25 * support + 0.1 * (1.0 - free)),
        (short, "short_unknown_gap_closure", 0.55 + 0.35 * unknown + 0.1 * support),
        (door, "doorway_virtual_cut", 0.60 + 0.30 * free + 0.10 * fit),
    ]
    return F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("kind"), clip(score).alias("confidence"))) for cond, name, score in kinds]), lambda x: x.isNotNull())


def _marks(runs: DataFrame, free: DataFrame, unknown: DataFrame, keys: list[str], height: int, width: int, most: int, half: int, along: int, band: int) -> DataFrame:
    """(keys, axis, ta, tl, marks): by tile the free and unknown cells of all lines and places that a gap starting there may have, as words of 64 bits."""
    on_map = lambda df, name: df.select(*keys, "r", "c", F.lit(name).alias("kind")).where(raster.within(height, width))
    axes = runs.select(*keys, "axis").distinct()
    cells = on_map(free, "f").unionByName(on_map(unknown, "u")).groupBy(*keys, "r", "c").agg(F.max(F.col("kind") == "f").alias("f"), F.max(F.col("kind") == "u").alias("u"))
    across = F.col("axis") == "horizontal"
    at = raster.spread(cells).join(axes, keys).select(*keys, "axis", "f", "u", F.when(across, F.col("r")).otherwise(F.col("c")).alias("line"), F.when(across, F.col("c")).otherwise(F.col("r")).alias("at"))
    tiles = lambda low, high, size: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    at = at.withColumn("ta", tiles(F.col("at") - most + 1, F.col("at"), along)).withColumn("tl", tiles(F.col("line") - half, F.col("line") + half, band))
    place = F.col("at") - F.col("ta") * along
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = at.withColumns({"word": F.floor(place / 64), "bit": bit}).groupBy(*keys, "axis", "ta", "tl", "line", "word").agg(*[F.bit_or(F.when(F.col(x), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(x) for x in "fu"])
    return words.groupBy(*keys, "axis", "ta", "tl").agg(F.collect_list(F.struct("line", "word", "f", "u")).alias("marks"))


def _marked(name: str, along: int) -> Column:
    """How many cells of a gap (ta, line, first, last) are marked."""
    def some(m: Column) -> Column:
        start = F.col("ta") * along + m["word"] * 64
        low, high = F.greatest(F.col("first") - start, F.lit(0)), F.least(F.col("last") - start, F.lit(63))
        inside = F.call_function("shiftleft", F.lit(-1).cast("long"), low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - high).cast("int")))
        return F.when(low <= high, F.bit_count(m[name].bitwiseAND(inside))).otherwise(0)

    return F.aggregate(F.filter("marks", lambda m: m["line"] == F.col("line")), F.lit(0), lambda n, m: n + some(m))


def facing_gaps(runs: DataFrame, free: DataFrame, unknown: DataFrame, keys: list[str], height: int, width: int, rules: GapRules = GapRules()) -> DataFrame:
    """(keys, kind, axis, line, first, last, length_m, confidence, wall_support, free_ratio, unknown_ratio, runs): gaps between runs of one direction on nearly the same line.

    runs: (keys, run_id, axis, line, first, last, confidence). A run meets the
    runs whose start lies near its end on a neighbouring line, by tiles of the map, so the join grows
    with runs that are near, not with all pairs. A tile's free and unknown cells
    come to the pairs as words of 64 bits, so no gap is spread into its cells.
    Of equal candidates the one of the first runs stays.
    """
    most, lateral = rules.most_cells, max(0, round(rules.most_lateral / rules.resolution))
    along, band = 4 * (most + 1), 2 * (lateral + 1)
    tiles = lambda low, high, size: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    runs = cut(runs.select(*keys, "run_id", "axis", "line", "first", "last", "confidence"), "runs")
    place = [*keys, "axis", "ta", "tl"]
    left = runs.select(*keys, "axis", F.floor((F.col("last") + 1) / along).alias("ta"), F.floor(F.col("line") / band).alias("tl"), F.struct("run_id", "line", "last", "confidence").alias("a"))
    right = runs.select(*keys, "axis", tiles(F.col("first") - most, F.col("first") - 1, along).alias("ta"), F.struct("run_id", "line", "first", "confidence").alias("b"))
    right = right.withColumn("tl", tiles(F.col("b.line") - lateral, F.col("b.line") + lateral, band))
    gap = F.col("b.first") - F.col("a.last") - 1
    pairs = raster.spread(left).join(right, place).where((F.abs(F.col("a.line") - F.col("b.line")) <= lateral) & (gap >= 1) & (gap <= most))
    pairs = pairs.join(raster.spread(_marks(runs, free, unknown, keys, height, width, most, (lateral + 1) // 2, along, band)), place, "left")
    line = F.rint((F.col("a.line") + F.col("b.line")) / 2).cast("int")
    pairs = pairs.select(*place, "marks", line.alias("line"), (F.col("a.last") + 1).alias("first"), (F.col("b.first") - 1).alias("last"), F.least("a.confidence", "b.confidence").alias("wall_support"), F.struct(F.least("a.run_id", "b.run_id").alias("low"), F.greatest("a.run_id", "b.run_id").alias("high")).alias("runs"))
    across = F.col("axis") == "horizontal"
    # the gap's cells on the map
    size, wide = F.when(across, height).otherwise(width), F.when(across, width).otherwise(height)
    n = F.when((F.col("line") >= 0) & (F.col("line") < size), F.greatest(F.lit(0), F.least(F.col("last"), wide - 1) - F.greatest(F.col("first"), F.lit(0)) + 1)).otherwise(0)
    ratio = lambda name: F.when(n > 0, F.coalesce(_marked(name, along), F.lit(0)) / n).otherwise(0.0)
    rows = pairs.select(*keys, "axis", "line", "first", "last", "wall_support", "runs", ratio("f").alias("free_ratio"), ratio("u").alias("unknown_ratio")).withColumn("length_m", (F.col("last") - F.col("first") + 1) * rules.resolution)
    rows = rows.select("*", F.explode(_kinds(rules)).alias("k")).select("*", "k.kind", "k.confidence").drop("k")
    kept = ["length_m", "confidence", "wall_support", "free_ratio", "unknown_ratio", "runs"]
    return rows.groupBy(*keys, "kind", "axis", "line", "first", "last").agg(F.min_by(F.struct(*kept), "runs").alias("x")).select(*keys, "kind", "axis", "line", "first", "last", "x.*")


@dataclass(frozen=True)
class PatternRules:
    """Least lengths of the runs in a scan; fixed values of the method."""

    free: int = 3
    occupied: int = 3
    unknown: int = 1


#: State of a cell: free, occupied, both, else unknown.
STATE = "case when unknown then 'U' when occupied and free then 'X' when occupied then 'O' when free then 'F' else 'U' end"


def _strings(cells: DataFrame, keys: list[str], line: str, place: Column, n: int) -> DataFrame:
    """(keys, line, states): the states along each line as one string, a cell without a row is unknown."""
    rows = cells.select(*keys, line, place.cast("int").alias("at"), "state").where(F.col("at").between(0, n - 1)).groupBy(*keys, line, "at").agg(F.min("state").alias("state"))
    met = rows.groupBy(*keys, line).agg(F.map_from_entries(F.collect_list(F.struct("at", "state"))).alias("m"))
    return met.select(*keys, line, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit("U"))), "").alias("states"))


def pattern_doors(cells: DataFrame, keys: list[str], box: tuple[int, int, int, int], rules: PatternRules = PatternRules()) -> DataFrame:
    """(keys, c, rule, free_cells, occupied_cells, unknown_cells, turn, reason_b, reason_a) of the columns of a box that start free at its bottom row.

    cells: (keys, r, c, free, occupied, unknown). Scans go up. Rule
    free_occupied_unknown wants free, occupied, then unknown cells to the top;
    rule free_turn_occupied wants a free run, and only occupied cells beside its
    last cell to the left or right border. The first rule that fits is
    named; the reasons say where each failed.
    """
    r0, c0, r1, c1 = box
    rows = cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).withColumn("state", F.expr(STATE))
    up = _strings(rows, keys, "c", r1 - F.col("r"), r1 - r0 + 1).where(F.col("states").startswith("F"))
    run = lambda text, s: F.length(F.regexp_extract(text, f"^{s}*", 0))
    rest = lambda n: F.expr(f"substring(states, {n} + 1)")
    up = up.withColumn("nf", run("states", "F")).withColumn("no", run(rest("nf"), "O")).withColumn("nu", run(rest("nf + no"), "U"))
    after = F.expr("substring(states, nf + 1, 1)")
    reason_b = F.when(F.col("nf") < rules.free, "free_run_too_short").when(after == "U", "unknown_below_occupied").when(F.col("no") < rules.occupied, "occupied_run_too_short").when(F.col("nu") < rules.unknown, "unknown_tail_missing").when(F.col("nf") + F.col("no") + F.col("nu") < F.length("states"), "non_unknown_after_unknown_tail")
    across = _strings(rows, keys, "r", F.col("c") - c0, c1 - c0 + 1).select(*keys, "r", run("states", "O").alias("from_left"), run(F.reverse("states"), "O").alias("from_right"))
    scans = up.withColumn("r", r1 - F.col("nf") + 1).join(across, [*keys, "r"], "left")
    side = lambda length, found: (length >= rules.occupied) & (F.coalesce(found, F.lit(0)) >= length)
    turn = F.when(side(F.col("c") - c0, F.col("from_left")), "left").when(side(c1 - F.col("c"), F.col("from_right")), "right")
    scans = scans.withColumns({"turn": turn, "reason_b": reason_b})
    reason_a = F.when(after == "U", "unknown_in_lower_free_run").when(F.col("nf") < rules.free, "free_run_too_short").when(F.col("turn").isNull(), "no_valid_turn_with_all_occupied_after")
    scans = scans.withColumn("reason_a", reason_a)
    fits_b = F.col("reason_b").isNull()
    fits_a = ~fits_b & F.col("reason_a").isNull()
    beside = F.when(F.col("turn") == "left", F.col("c") - c0).otherwise(c1 - F.col("c"))
    count = lambda b, a: F.when(fits_b, b).when(fits_a, a).otherwise(0).cast("int")
    return scans.select(
        *keys, "c", F.when(fits_b, "free_occupied_unknown").when(fits_a, "free_turn_occupied").alias("rule"), count(F.col("nf"), F.col("nf")).alias("free_cells"), count(F.col("no"), beside).alias("occupied_cells"), count(F.col("nu"), F.lit(0)).alias("unknown_cells"),
        F.when(fits_a, F.col("turn")).alias("turn"), "reason_b", F.when(~fits_b, F.col("reason_a")).alias("reason_a"),
    )
