"""Label maps and their evaluation: contingency, IoU, assignment, area filters, two-level means.

Label tables hold (keys, r, c, label) for label > 0 alone; an absent cell is
background. Contingency is one aggregate over a full outer join by cell;
assignment runs on the small IoU table of a frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .raster import spread


def relabelled(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels as 1..n in ascending order; the distinct labels are ranked, not the cells."""
    positive = labels.where("label > 0")
    ranks = positive.select(*keys, "label").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("label")))
    return positive.join(spread(ranks), [*keys, "label"]).select(*keys, "r", "c", F.col("rank").alias("label"))


def relabelled_as(labels: DataFrame, keys: list[str], order: list[int]) -> DataFrame:
    """The listed labels alone, numbered in the list's order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("label"))
    return labels.where(F.col("label").isin(order)).select(*keys, "r", "c", place.cast("int").alias("label"))


def contingency(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt, pred, cells) of cells that either map labels, 0 for background."""
    a, b = truth.where("label > 0").select(*keys, "r", "c", F.col("label").alias("gt")), found.where("label > 0").select(*keys, "r", "c", F.col("label").alias("pred"))
    joined = a.join(b, [*keys, "r", "c"], "full_outer")
    return joined.groupBy(*keys, F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("pred", F.lit(0)).alias("pred")).agg(F.count("*").alias("cells"))


def ious(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt, pred, iou) of pairs that share cells."""
    a = table.where("gt > 0").groupBy(*keys, "gt").agg(F.sum("cells").alias("area_gt"))
    b = table.where("pred > 0").groupBy(*keys, "pred").agg(F.sum("cells").alias("area_pred"))
    pairs = table.where("gt > 0 and pred > 0").join(a, [*keys, "gt"]).join(b, [*keys, "pred"])
    return pairs.select(*keys, "gt", "pred", (F.col("cells") / (F.col("area_gt") + F.col("area_pred") - F.col("cells"))).alias("iou"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment with the largest total, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], j = row, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            i = owner[j]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(free)) + 1
            delta = free[nxt - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j = nxt
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def kept_labels(cells: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which truth rows and found columns of a frame's contingency stay (row and column 0 are background).

    Found labels are clipped to the truth, small labels of both go, the found
    ones are clipped to the truth that is left, and small ones go again.
    """
    gt, pred = np.ones(len(cells), bool), np.ones(cells.shape[1], bool)
    gt[0] = pred[0] = False
    if least > 1:
        pred &= cells[1:].sum(0) >= least
        gt &= cells.sum(1) >= least
        pred &= cells[gt].sum(0) >= least
    return gt, pred


def matched(table: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """(keys, n_gt, n_pred, miou, pairs) by frame: the mean over truth labels of the matched IoU, unmatched ones 0.

    A frame's contingency goes to one row; filters, IoU and assignment run on
    it. Labels of `pairs` are numbered anew where small ones went.
    """
    rows = table.groupBy(*keys).agg(F.collect_list(F.struct(F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred"), "cells")).alias("pairs"))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf["pairs"]:
                gts, g = np.unique([0, *(p["gt"] for p in row)], return_inverse=True)
                preds, f = np.unique([0, *(p["pred"] for p in row)], return_inverse=True)
                cells = np.zeros((len(gts), len(preds)), np.int64)
                cells[g[1:], f[1:]] = [p["cells"] for p in row]
                gt, pred = kept_labels(cells, least)
                if least > 1:  # outside the truth that is left nothing is found
                    cells = np.where(gt[:, None], cells, 0)
                both = cells[gt][:, pred]
                union = (cells[gt].sum(1)[:, None] + cells[:, pred].sum(0) - both) if both.size else both
                iou = both / np.maximum(union, 1)
                pairs = assignment(iou) if iou.size else []
                name = (lambda ids, keep: np.arange(1, keep.sum() + 1) if least > 1 else ids[keep])
                a, b = name(gts, gt), name(preds, pred)
                out.append((int(gt.sum()), int(pred.sum()), float(sum(iou[i, j] for i, j in pairs)) / max(int(gt.sum()), 1), [{"gt": int(a[i]), "pred": int(b[j]), "iou": float(iou[i, j])} for i, j in pairs]))
            yield pdf[keys].assign(**{n: [o[k] for o in out] for k, n in enumerate(("n_gt", "n_pred", "miou", "pairs"))})

    kinds = dict(table.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_gt long", "n_pred long", "miou double", "pairs array<struct<gt:long,pred:long,iou:double>>"])
    return rows.mapInPandas(solve, schema)


def clipped_to(labels: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """Labels inside the domain, numbered anew."""
    return relabelled(labels.join(domain.select(*keys, "r", "c").distinct(), [*keys, "r", "c"], "left_semi"), keys)


def without_small(labels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Labels of fewer cells dropped and the rest numbered anew; a limit of one cell or less drops none."""
    if least <= 1:
        return relabelled(labels, keys)
    large = labels.where("label > 0").groupBy(*keys, "label").count().where(F.col("count") >= least).select(*keys, "label")
    return relabelled(labels.join(large, [*keys, "label"], "left_semi"), keys)


def prepared(truth: DataFrame, found: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Both maps as metrics want them: clip to the truth, filter both, clip to the surviving truth, filter again."""
    inside = clipped_to(found, truth.where("label > 0"), keys)
    truth = without_small(truth, keys, least)
    return truth, without_small(clipped_to(without_small(inside, keys, least), truth, keys), keys, least)


def snapshot_metrics(truth: DataFrame, found: DataFrame, keys: list[str], least: int = 0, reviews: DataFrame | None = None) -> DataFrame:
    """(keys, n_gt, n_pred, usr, osr, miou, pairs[, csr]) by frame."""
    rows = matched(contingency(truth, found, keys), keys, least)
    rows = rows.withColumn("usr", scalar.under_segmentation(F.col("n_gt"), F.col("n_pred"))).withColumn("osr", scalar.over_segmentation(F.col("n_gt"), F.col("n_pred")))
    return rows if reviews is None else rows.join(reviews.select(*keys, "csr"), keys, "left")


def invalid_reason(n_gt: Column, n_domain: Column, csr: Column, require_csr: bool) -> Column:
    """Why a snapshot can't count, null where it does: the first failing test."""
    return F.when(n_domain <= 0, "empty_metric_domain").when(n_gt <= 0, "empty_ground_truth").when(F.lit(require_csr) & csr.isNull(), "missing_csr").when(csr.isNotNull() & ~csr.isin(0, 1), "bad_csr")


def backprojected(truth: DataFrame, domain: DataFrame, keys: list[str], least_visible: int) -> DataFrame:
    """The final truth on a step's domain, labels with too few visible cells dropped, numbered anew. truth has keys without the step."""
    frame = [k for k in keys if k in truth.columns]
    seen = domain.select(*keys, "r", "c").distinct().join(truth.where("label > 0"), [*frame, "r", "c"])
    return without_small(seen.select(*keys, "r", "c", "label"), keys, max(least_visible, 0))


def merged(labels: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (group_id, label) united to their smallest label, then numbered anew."""
    head = groups.groupBy("group_id").agg(F.min("label").alias("head"))
    to = groups.join(head, "group_id").groupBy("label").agg(F.min("head").alias("head"))
    return relabelled(labels.join(to, "label", "left").select(*keys, "r", "c", F.coalesce("head", "label").alias("label")), keys)


def metric_domain(cells: DataFrame, keys: list[str], preferred: str = "nav_free_domain", fallback: str = "observed_free") -> DataFrame:
    """Free cells without obstacle or unknown ones; a frame whose preferred layer is all false or missing falls back."""
    usable = F.max(F.coalesce(F.col(preferred), F.lit(False))).over(Window.partitionBy(*keys))
    chosen = F.when(usable, F.coalesce(F.col(preferred), F.lit(False))).otherwise(F.coalesce(F.col(fallback), F.lit(False)))
    rows = cells.withColumn("__domain", chosen & ~F.coalesce("obstacle", F.lit(False)) & ~F.coalesce("unknown", F.lit(False)))
    return rows.where("__domain").select(*keys, "r", "c")


def adjacency(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, border) of touching labels: pairs of 4-neighbours, a < b."""
    here = labels.where("label > 0").select(*keys, "r", "c", F.col("label").alias("x"))
    step = lambda dr, dc: here.select(*keys, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("x").alias("y"))
    pairs = here.join(spread(step(1, 0).union(step(0, 1))), [*keys, "r", "c"]).where("x <> y")
    return pairs.groupBy(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("border"))


def perimeters(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, perimeter): sides of cells that face another label or none."""
    here = labels.where("label > 0").select(*keys, "r", "c", "label")
    sides = here.select(*keys, "label", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("n"))
    other = here.select(*keys, "r", "c", F.col("label").alias("y"))
    faced = sides.select(*keys, "label", "n.r", "n.c").join(spread(other), [*keys, "r", "c"], "left")
    return faced.where("y is null or y <> label").groupBy(*keys, "label").agg(F.count("*").alias("perimeter"))


def episode_first(rows: DataFrame, episode: list[str], measures: list[str], valid: str = "valid") -> tuple[DataFrame, DataFrame]:
    """Means by episode over its valid snapshots, and their mean over episodes beside the pooled mean over snapshots."""
    good = rows.where(F.col(valid))
    by = good.groupBy(*episode).agg(F.count("*").alias("snapshots"), *[F.avg(m).alias(m) for m in measures])
    pooled = good.agg(F.count("*").alias("snapshots"), *[F.avg(m).alias(f"pooled_{m}") for m in measures])
    return by, by.agg(F.count("*").alias("episodes"), *[F.avg(m).alias(m) for m in measures]).join(F.broadcast(pooled))  # one row each


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Episodes, valid ones, success rate, path measures and a histogram of fallbacks by group."""
    flag = lambda c: F.avg(F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0))
    mean = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))) / F.count("*")
    valid = F.sum(F.when(F.coalesce(F.col("metric_valid"), F.lit(False)), 1).otherwise(0))
    main = rows.groupBy(*by).agg(F.count("*").alias("episodes"), valid.alias("metric_valid_episodes"), (F.count("*") - valid).alias("non_metric_episodes"), flag("success").alias("sr"), mean("spl").alias("spl"), mean("softspl").alias("softspl"), mean("distance_to_goal").alias("mean_dtg"), mean("path_length").alias("mean_path_length"))
    counts = rows.select(*by, F.explode("fallbacks_used").alias("fallback")).groupBy(*by, "fallback").count()
    histogram = counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fallback", "count")))).alias("fallback_counts"))
    same = [main[k].eqNullSafe(histogram[k]) for k in by]
    return main.join(histogram, same, "left").select(*[main[c] for c in main.columns], F.coalesce("fallback_counts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>"))).alias("fallback_counts"))


def mean_and_deviation(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[f.alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg(m)), ("std", F.stddev_pop(m)))])


def path_length(points: DataFrame, keys: list[str], order: str, jump_m: float = 0.5) -> DataFrame:
    """Running length; a step of the jump or more adds nothing, but the place moves on."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = scalar.distance(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = points.withColumn("__d", F.when(d < jump_m, d).otherwise(0.0))
    return rows.withColumn("path_m", F.sum("__d").over(w)).drop("__d")


def score_normalised(rows: DataFrame, value: str, mode: str, keys: list[str]) -> DataFrame:
    """none, minmax or zscore within the keys; 0 where the set has no spread."""
    w = Window.partitionBy(*keys)
    x = F.col(value)
    out = {"none": x, "minmax": (x - F.min(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0.0)), "zscore": (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))}[mode]
    return rows.withColumn("score", F.coalesce(out, F.lit(0.0)))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which half the weight is reached."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return rows.withColumn("__at", F.sum(weight).over(w) >= total / 2).where("__at").groupBy(*keys).agg(F.min(value).alias("median"))


def same_snapshots(runs: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """Snapshots that some method lacks: (method, keys), empty where all have the same set."""
    methods, all_keys = runs.select(method).distinct(), runs.select(*keys).distinct()
    return methods.crossJoin(all_keys).join(runs.select(method, *keys).distinct(), [method, *keys], "left_anti")

