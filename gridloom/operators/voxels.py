"""Rays and voxels: exact cell traversal, log-odds folds, column projections and classifiers.

Voxels are sparse rows (keys, z, r, c); an absent row is unknown. Events are
pre-aggregated per frame before they are shuffled by voxel, and folds run over
a voxel's frames in order, as clamped sums depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster

UNKNOWN, FREE, OCCUPIED, CONFLICT = 0, 1, 2, 3
#: Cells of rays in one task.
CELLS_A_TASK = 1 << 19


@dataclass(frozen=True)
class LogOdds:
    """Weights, caps by frame, clamp and thresholds of the fold; fixed values of the model."""

    hit: int = 4
    miss: int = -1
    most_hits: int = 3
    most_misses: int = 1
    clamp: int = 20
    occupied_at: int = 1
    free_at: int = -1
    release_at: int = -6


def clipped(p0: list[Column], p1: list[Column], sizes: list[int]) -> Column:
    """(t0, t1) of the part of a segment inside the box [0, size), null where there is none."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    misses = F.lit(False)
    for a, b, n in zip(p0, p1, sizes):
        d = b - a
        enter, leave = (0 - a) / F.nullif(d, F.lit(0.0)), (n - a) / F.nullif(d, F.lit(0.0))
        low.append(F.when(d == 0, 0.0).otherwise(F.least(enter, leave)))
        high.append(F.when(d == 0, 1.0).otherwise(F.greatest(enter, leave)))
        misses = misses | ((d == 0) & ((a < 0) | (a >= n)))
    t0, t1 = F.greatest(*low), F.least(*high)
    return F.when(~misses & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def traversed(p0: list[Column], p1: list[Column], names: tuple[str, ...] = ("z", "r", "c"), eps: float = 1e-6) -> Column:
    """Ordered cells of a segment in voxel coordinates: crossing times of all axes, sorted, near ties as one, floors at the midpoints."""
    def crossings(a: Column, b: Column) -> Column:
        low, high = F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b))
        return F.when(high >= low, F.transform(F.sequence(low, high), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    times = F.array_sort(F.concat(*[crossings(a, b) for a, b in zip(p0, p1)]))
    apart = lambda ts: F.filter(ts, lambda t, i: F.when(i == 0, t > eps).otherwise(t - F.get(ts, i - 1) > eps) & (t < 1 - eps))
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    bounds = let(times, lambda ts: F.concat(F.array(F.lit(0.0)), apart(ts), F.array(F.lit(1.0))))

    def cells(b):
        middle = lambda i: (F.get(b, i) + F.get(b, i + 1)) / 2
        cell = lambda m: F.struct(*[F.floor(x + (y - x) * m).cast("int").alias(n) for n, x, y in zip(names, p0, p1)])
        return F.transform(F.transform(F.sequence(F.lit(0), F.size(b) - 2), middle), cell)

    return let(bounds, cells)


def ray_events(rays: DataFrame, keys: list[str], sizes: tuple[int, int, int], drop_last: int = 1, most_samples: int = 320) -> DataFrame:
    """(keys, z, r, c, free, occupied) counts of a frame's rays.

    rays: (keys, oz, or_, oc, ez, er, ec, is_hit) in voxel coordinates. A hit
    ray marks its endpoint occupied and leaves its last `drop_last` cells out
    of the free ones; a ray without a hit keeps them. Rays are dealt to tasks
    by frame and by the cells that they cross, so cells are never shuffled.
    """
    origin, end = [F.col(x) for x in ("oz", "or_", "oc")], [F.col(x) for x in ("ez", "er", "ec")]
    crossed = F.least(F.lit(float(most_samples)), sum((F.abs(b - a) for a, b in zip(origin, end)), F.lit(1.0)))
    rows = rays.select(*keys, *origin, *end, "is_hit")
    if not rays.isStreaming:
        rows = rows.repartition(raster.tasks_of(rows, CELLS_A_TASK, crossed), *keys)
    rows = rows.withColumn("cells", F.slice(traversed(origin, end), 1, most_samples))
    kept = F.when(F.col("is_hit"), F.slice("cells", 1, F.greatest(F.size("cells") - drop_last, F.lit(0)))).otherwise(F.col("cells"))
    free = F.transform(kept, lambda v: F.struct(*[v[n].alias(n) for n in ("z", "r", "c")], F.lit(0).alias("hit")))
    hit = F.when(F.col("is_hit"), F.array(F.struct(*[F.floor(x).cast("int").alias(n) for x, n in zip(end, ("z", "r", "c"))], F.lit(1).alias("hit"))))
    inside = (F.col("z").between(0, sizes[0] - 1)) & (F.col("r").between(0, sizes[1] - 1)) & (F.col("c").between(0, sizes[2] - 1))
    marks = rows.select(*keys, F.explode(F.flatten(F.array_compact(F.array(free, hit)))).alias("v")).select(*keys, "v.*").where(inside)
    return marks.groupBy(*keys, "z", "r", "c").agg(F.sum(1 - F.col("hit")).alias("free"), F.sum("hit").alias("occupied"))


def fold_step(model: LogOdds):
    """One frame on a voxel: a hit wins over misses, each add is clamped, an occupied voxel is freed only at the release value."""
    bound = lambda x: F.greatest(F.lit(-model.clamp), F.least(F.lit(model.clamp), x))

    def one(s, e):
        misses = F.when(e["o"] > 0, 0).otherwise(F.least(e["f"], F.lit(model.most_misses)))
        v = bound(bound(s["v"] + model.miss * misses) + model.hit * F.least(e["o"], F.lit(model.most_hits)))
        freed = (v <= model.free_at) & ((s["s"] != OCCUPIED) | (v <= model.release_at))
        return F.struct(v.cast("int").alias("v"), F.when(v >= model.occupied_at, OCCUPIED).when(freed, FREE).otherwise(s["s"]).alias("s"))

    return one


def folded(events: DataFrame, keys: list[str], step: str = "step", model: LogOdds = LogOdds()) -> DataFrame:
    """(keys, log_odds, state) after all frames. events: one row by voxel and frame, with free and occupied counts."""
    start = F.struct(F.lit(0).alias("v"), F.lit(UNKNOWN).alias("s"))
    frames = F.array_sort(F.collect_list(F.struct(F.col(step).alias("t"), F.col("free").cast("int").alias("f"), F.col("occupied").cast("int").alias("o"))))
    out = events.groupBy(*keys).agg(F.aggregate(frames, start, fold_step(model)).alias("x"))
    return out.select(*keys, F.col("x.v").alias("log_odds"), F.col("x.s").alias("state"))


def forced_free(voxels: DataFrame, keys: list[str], forced: DataFrame, model: LogOdds = LogOdds()) -> DataFrame:
    """Voxels with the forced ones clamped to free, whatever they were."""
    low = min(model.free_at, model.release_at)
    marked = voxels.join(forced.select(*keys).distinct().withColumn("__f", F.lit(True)), keys, "full_outer")
    return marked.select(*keys, F.when(F.col("__f"), F.least(F.coalesce("log_odds", F.lit(0)), F.lit(low))).otherwise(F.col("log_odds")).alias("log_odds"), F.when(F.col("__f"), FREE).otherwise(F.col("state")).alias("state"))


def seen_counts(marks: DataFrame, keys: list[str], frame: str = "step", delta: int = 1, most: int = 255) -> DataFrame:
    """Distinct frames that saw a voxel, times delta, saturated."""
    return marks.select(*keys, frame).distinct().groupBy(*keys).agg(F.least(F.lit(most), F.count("*") * delta).alias("seen"))


def decayed_counts(marks: DataFrame, keys: list[str], last_frame: int, frame: str = "step", delta: int = 1, decay: int = 1, most: int = 255) -> DataFrame:
    """The same with a global decrement at every frame, floored at zero, also over frames that saw nothing."""
    def one(s, t):
        return F.struct(F.least(F.lit(most), F.greatest(F.lit(0), s["v"] - decay * (t - s["t"])) + delta).cast("long").alias("v"), t.alias("t"))

    frames = F.array_sort(F.collect_set(F.col(frame).cast("long")))
    out = marks.groupBy(*keys).agg(F.aggregate(frames, F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("t")), one).alias("x"))
    return out.select(*keys, F.greatest(F.lit(0), F.col("x.v") - decay * (last_frame - F.col("x.t"))).alias("seen"))


def endpoint_scores(events: DataFrame, keys: list[str], frame: str = "step", gain: int = 2, most: int = 65_535) -> DataFrame:
    """Per cell over frames: +gain once for a hit, then -1 for a free crossing, kept in [0, most]. events: (keys, frame, hit, crossed)."""
    once = events.groupBy(*keys, frame).agg(F.max("hit").alias("hit"), F.max("crossed").alias("crossed"))

    def one(v, e):
        return F.greatest(F.lit(0), F.least(F.lit(most), v + F.when(e["hit"], gain).otherwise(0)) - F.when(e["crossed"], 1).otherwise(0))

    frames = F.array_sort(F.collect_list(F.struct(frame, "hit", "crossed")))
    return once.groupBy(*keys).agg(F.aggregate(frames, F.lit(0), one).alias("score"))


def outside_scores(frames: DataFrame, keys: list[str], frame: str = "step", gain: int = 1, decay: int = 1, most: int = 255, threshold: int = 2) -> DataFrame:
    """Per cell: +gain in frames where it is a candidate, decay otherwise, 0 where cleared; outside at the threshold. frames: (keys, frame, candidate, cleared)."""
    def one(v, e):
        return F.when(e["cleared"], 0).when(e["candidate"], F.least(F.lit(most), v + gain)).otherwise(F.greatest(F.lit(0), v - decay))

    rows = F.array_sort(F.collect_list(F.struct(frame, "candidate", "cleared")))
    out = frames.groupBy(*keys).agg(F.aggregate(rows, F.lit(0), one).alias("score"))
    return out.withColumn("outside", F.col("score") >= threshold)


def projected(voxels: DataFrame, keys: list[str], obstacle: tuple[int, int], free: tuple[int, int], least_free: int = 1) -> DataFrame:
    """Columns for navigation: occupied if any voxel of the obstacle band is, else free by a count in the free band."""
    occ = (F.col("state") == OCCUPIED) & F.col("z").between(*obstacle)
    fre = (F.col("state") == FREE) & F.col("z").between(*free)
    out = voxels.groupBy(*keys, "r", "c").agg(F.max(occ).alias("occupied"), F.sum(F.when(fre, 1).otherwise(0)).alias("n_free"))
    out = out.withColumn("free", ~F.col("occupied") & (F.col("n_free") >= least_free))
    return out.withColumn("observed", F.col("occupied") | F.col("free")).withColumn("unknown", ~F.col("observed"))


def ceiling_peak(voxels: DataFrame, keys: list[str], band: tuple[int, int], least: int = 1) -> DataFrame:
    """The layer of the band with most occupied voxels, the highest at a tie; none under the least count."""
    layers = voxels.where((F.col("state") == OCCUPIED) & F.col("z").between(*band)).groupBy(*keys, "z").count()
    top = layers.groupBy(*keys).agg(F.max(F.struct("count", "z")).alias("top"))
    return top.where(F.col("top.count") >= least).select(*keys, F.col("top.z").alias("ceiling_z"), F.col("top.count").alias("peak"))


def locked_ceiling(estimates: DataFrame, keys: list[str], frame: str, value: str, frames: int) -> DataFrame:
    """Estimates of frames in order, held from the given number of valid ones on."""
    order = Window.partitionBy(*keys).orderBy(frame)
    rows = estimates.withColumn("valid", F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0)).over(order))
    at = F.when((F.col("valid") == frames) & F.col(value).isNotNull(), F.col(value))
    held = F.first(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("height", F.coalesce(held, F.last(value, ignorenulls=True).over(order))).withColumn("locked", held.isNotNull()).drop("valid")


def in_frustum(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int, near: float, far: float) -> Column:
    """Whether a point in camera coordinates projects into the image at an allowed depth."""
    u, v = fx * x / F.nullif(z, F.lit(0.0)) + cx, fy * y / F.nullif(z, F.lit(0.0)) + cy
    return F.coalesce(z.between(near, far) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def column_classes(voxels: DataFrame, keys: list[str], free_ratio: float = 0.5, wall_ratio: float = 0.3, least_seen: int = 1) -> DataFrame:
    """Counts, ratios and one class by column: free before wall before unknown. voxels: every active bin, with state and seen."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    state, seen = F.col("state"), F.coalesce(F.col("seen"), F.lit(0)) >= least_seen
    out = voxels.groupBy(*keys, "r", "c").agg(F.count("*").alias("n"), n(state == FREE).alias("n_free"), n(state == OCCUPIED).alias("n_occupied"), n((state == UNKNOWN) & seen).alias("n_unknown_in_range"), n((state == UNKNOWN) & ~seen).alias("n_unknown_out_of_range"))
    observed = F.col("n_free") + F.col("n_occupied") + F.col("n_unknown_in_range")
    out = out.withColumn("free_ratio", F.col("n_free") / F.greatest(observed, F.lit(1))).withColumn("wall_ratio", F.col("n_occupied") / F.greatest(observed, F.lit(1)))
    return out.withColumn("class", F.when((F.col("n_free") > 0) & (F.col("free_ratio") >= free_ratio), "free").when((F.col("n_occupied") > 0) & (F.col("wall_ratio") >= wall_ratio), "wall").otherwise("unknown"))


@dataclass(frozen=True)
class DoorSeedRules:
    """Limits of the door-seed test on a column; heights in metres."""

    z0: float = 0.0
    z_step: float = 0.05
    extent_scale: float = 0.5
    least_lower_free: int = 4
    least_upper_occupied: int = 1
    least_upper_active: int = 1
    turn_min_m: float = 1.8
    turn_max_m: float | None = None
    lower_free_ratio: float = 0.5
    upper_solid_ratio: float = 0.8
    upper_in_range_unknown_ratio: float = 0.25
    upper_free_ratio: float = 0.15
    first_upper_max_m: float | None = None
    ceiling_band_m: float = 0.0


def door_seed_reasons(voxels: DataFrame, keys: list[str], rules: DoorSeedRules = DoorSeedRules()) -> DataFrame:
    """(keys, r, c, turn_z, ..., reason) by column: free below a turning height, solid above it, first failing rule named.

    voxels: every active bin, with z (bin), state and seen. Out-of-range
    unknown counts as solid above the turn, in-range unknown does not.
    """
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    column = Window.partitionBy(*keys, "r", "c")
    z = rules.z0 + (F.col("z") + 0.5) * rules.z_step
    free, occ = F.col("state") == FREE, F.col("state") == OCCUPIED
    rows = voxels.select(*keys, "r", "c", "z", z.alias("h"), free.alias("free"), occ.alias("occ"), ((F.col("state") == UNKNOWN) & (F.coalesce(F.col("seen"), F.lit(0)) > 0)).alias("dim"), ((F.col("state") == UNKNOWN) & (F.coalesce(F.col("seen"), F.lit(0)) <= 0)).alias("dark"))
    span = F.rint((F.max(F.when(F.col("free"), F.col("h"))).over(column) - F.min(F.when(F.col("free"), F.col("h"))).over(column)) / rules.z_step) + 1
    extent = F.greatest(F.sum(F.when(F.col("free"), 1).otherwise(0)).over(column), F.coalesce(span, F.lit(0.0)))
    turn = F.round(F.avg(F.when(F.col("free"), F.col("h"))).over(column) + rules.extent_scale * extent * rules.z_step, 6)
    rows = rows.withColumn("turn_z", turn).withColumn("top", F.max("h").over(column)).withColumn("bottom", F.min("h").over(column)).withColumn("above", F.coalesce(F.col("h") >= F.col("turn_z"), F.lit(False)))
    band = F.col("h") >= F.col("top") - rules.ceiling_band_m - 1e-6 if rules.ceiling_band_m > 0 else F.lit(False)
    low_enough = F.col("h") <= rules.first_upper_max_m + 1e-6 if rules.first_upper_max_m else F.lit(True)
    up = F.col("above")
    got = rows.groupBy(*keys, "r", "c").agg(
        F.max("turn_z").alias("turn_z"), F.min("bottom").alias("bottom"), F.max("top").alias("top"), n(F.col("free")).alias("n_free"), n(F.col("occ")).alias("n_occ"),
        n(~up).alias("lower"), n(~up & F.col("free")).alias("lower_free"), n(up).alias("upper"), n(up & F.col("occ")).alias("upper_occ"), n(up & (F.col("occ") | F.col("dark"))).alias("upper_solid"),
        n(up & F.col("dim")).alias("upper_dim"), n(up & F.col("free")).alias("upper_free"), F.min(F.when(up & F.col("occ"), F.col("h"))).alias("first_upper"),
        n(up & F.col("occ") & ~band & low_enough).alias("upper_below_ceiling"), n(up & F.col("occ") & band).alias("upper_in_ceiling"),
        F.avg(F.when(F.col("occ"), F.col("h"))).alias("occ_centre"), F.avg(F.when(F.col("free"), F.col("h"))).alias("free_centre"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    c, out_of = F.col, (F.col("turn_z").isNull() | (F.col("turn_z") < F.col("bottom") - 1e-6) | (F.col("turn_z") > F.col("top") + 0.5 * rules.z_step + 1e-6))
    reasons = [
        (c("n_free") < rules.least_lower_free, "lower_free_cells_too_few"),
        (c("n_occ") < rules.least_upper_occupied, "upper_occupied_cells_too_few"),
        (out_of, "turn_outside_active_range"),
        (c("turn_z") < rules.turn_min_m, "turn_z_below_door_lintel_min"),
        (c("turn_z") > rules.turn_max_m if rules.turn_max_m else F.lit(False), "turn_z_above_door_lintel_max"),
        (c("lower") < rules.least_lower_free, "lower_free_cells_too_few"),
        (ratio("lower_free", "lower") < rules.lower_free_ratio, "lower_free_ratio_too_low"),
        (c("upper") < rules.least_upper_active, "upper_observed_cells_too_few"),
        (c("first_upper").isNull(), "upper_actual_occupied_cells_too_few"),
        (c("first_upper") > rules.first_upper_max_m if rules.first_upper_max_m else F.lit(False), "first_upper_occupied_too_high_ceiling_like"),
        ((c("upper_below_ceiling") <= 0) & (c("upper_in_ceiling") >= rules.least_upper_occupied), "upper_occupied_only_in_ceiling_band"),
        (c("upper_below_ceiling") < rules.least_upper_occupied, "upper_non_ceiling_actual_occupied_too_few"),
        (ratio("upper_solid", "upper") < rules.upper_solid_ratio, "upper_generalized_solid_ratio_too_low"),
        (ratio("upper_dim", "upper") > rules.upper_in_range_unknown_ratio, "upper_in_range_unknown_ratio_too_high"),
        (ratio("upper_free", "upper") > rules.upper_free_ratio, "upper_free_ratio_too_high"),
        (~F.coalesce(c("occ_centre") > c("free_centre"), F.lit(False)), "occupied_centroid_not_above_free_centroid"),
    ]
    reason = None
    for cond, name in reasons:
        reason = F.when(cond, name) if reason is None else reason.when(cond, name)
    return got.select(*keys, "r", "c", "turn_z", "lower_free", "upper_occ", "upper_solid", reason.otherwise("accepted").alias("reason"))
