"""Quality rules: robust multivariate outliers of text statistics, in SQL functions alone.

The base rules reject texts of few words or of much repetition. For the
others, a vector of transformed statistics is compared with the texts of the
same language and source. Mean and covariance of each group are a minimum
covariance determinant estimate, made regular by a least spread of each
statistic: from three starts (scaled distances from the medians, largest
scaled deviations, and all texts) two concentration steps each keep the half
of the texts nearest by Mahalanobis distance and estimate again; the start
with the least determinant goes on until no group's determinant falls any more.
The covariance is corrected for what a half leaves out, texts within the 0.975
quantile reweight the estimate, and that is corrected in turn. A text is
rejected where its squared distance exceeds `cut`.

Distribution: a step is one aggregate by group with partial sums, and a join
of the group table back to the statistics; medians come from mergeable
quantile sketches. Group tables are written and counted; they are sent to all
tasks while they have at most 100,000 rows, and joined by shuffle beyond. No
group is gathered in one place.

A covariance of few texts means little: groups under `least_group` texts share
one estimate of all such groups of their language, and languages without
enough of them one of all. `judged_by` names which one each text had: group,
language or all.

Nulls: a null text has no words and fails the base rules; a null language or
source is a group of its own. Every input row gives one row, repeated rows
too; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch
from .common import sized_broadcast, stash

SPACE = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
#: Statistics of the vector, and the least standard deviation of each that counts as real spread.
FLOORS = {"size": 0.3, "letters": 0.15, "symbols": 0.05, "lines": 0.15, "repeats": 0.15}
#: Quantiles of chi-square with five degrees of freedom (median, 0.975, 1 - 10^-6): fixed values of statistics tables.
CHI_MEDIAN, CHI_975, CHI_LAST = 4.3515, 12.8325, 35.888
DIMENSIONS = list(FLOORS)
#: Concentration steps of each start; steps of the best one at most, and the change of the logarithm of a determinant that counts.
FIRST_STEPS, MOST_STEPS, STILL = 2, 30, 1e-3
STARTS = ("scaled", "largest", "all")


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    total = math.erf(math.sqrt(x / 2))
    for k in range(1, degrees - 1, 2):
        total -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return total


def consistency(share: float, quantile: float) -> float:
    """What the covariance of the nearest share of a normal sample is to be multiplied by."""
    return share / chi_square(quantile, len(DIMENSIONS) + 2)


#: Factors of the nearest half and of the texts within the 0.975 quantile.
HALF, NEARLY_ALL = consistency(0.5, CHI_MEDIAN), consistency(0.975, CHI_975)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column, width: int) -> Column:
    """Words inside windows of `width` words that the list holds twice or more."""

    def windows(w):
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return let(hashes, lambda h: F.transform(at, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(width)])))

    def covered(h):
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            twice = F.filter(F.transform(s, lambda x, i: F.when(F.when(i > 0, same(i, i - 1)).otherwise(F.lit(False)) | F.when(i < last, same(i, i + 1)).otherwise(F.lit(False)), x["i"])), lambda x: x.isNotNull())
            return F.array_sort(twice)

        def union(p):
            return F.coalesce(F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(width), x - s["last"])).alias("n"), x.alias("last")))["n"], F.lit(0))

        return let(let(marked, places), union)

    found = let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))))
    return F.when(F.size(words) >= width, found).otherwise(F.lit(0)).cast("long")


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    solid = F.translate("text", " \t\n\x0b\x0c\r", "")
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    found = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w, 5).alias("n_repeat_words")))
    counts = rows.select(
        "doc_id",
        "lang",
        "source",
        found.alias("found"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
    )
    n, repeats = F.col("found.n_words"), F.col("found.n_repeat_words")
    failed = (n < 10) | (100 * repeats > 20 * n)
    return counts.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), failed.alias("base_failed"), "n_lines")


def _vector(counts: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of sizes, roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.sqrt(F.col(c) / of)
    return counts.withColumns({
        "size": F.log1p(F.col("n_words").cast("double")),
        "letters": F.log1p(F.col("word_chars") / n),
        "symbols": share("n_symbols", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        "lines": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        "repeats": share("n_repeat_words", n),
    })


def _estimate(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean, Cholesky factor of the covariance times `factor`, and the logarithm of its determinant, of each group's rows with `inside`."""
    kept = lambda c: F.when(F.col("inside"), c)
    means = {f"m_{a}": F.avg(kept(F.col(a))) for a in DIMENSIONS}
    seconds = {f"s_{a}_{b}": F.avg(kept(F.col(a) * F.col(b))) for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[: i + 1]}
    got = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in (means | seconds).items()])
    cover = lambda a, b: (F.col(f"s_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) * factor + (F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0))
    for i, a in enumerate(DIMENSIONS):
        for j, b in enumerate(DIMENSIONS[: i + 1]):
            less = reduce(lambda x, y: x + y, [F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}") for c in DIMENSIONS[:j]], F.lit(0.0))
            value = F.sqrt(F.greatest(cover(a, a) - less, F.lit(FLOORS[a] ** 2 / 4))) if i == j else (cover(a, b) - less) / F.col(f"l_{b}_{b}")
            got = got.withColumn(f"l_{a}_{b}", value)
    spread = reduce(lambda x, y: x + y, [2 * F.ln(F.col(f"l_{a}_{a}")) for a in DIMENSIONS])
    return got.select(*keys, *means, *[f"l_{a}_{b}" for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[: i + 1]], spread.alias("spread"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    def nest(i: int, solved: list[Column]) -> Column:
        if i == len(DIMENSIONS):
            return reduce(lambda x, y: x + y, [s * s for s in solved])
        a = DIMENSIONS[i]
        rest = reduce(lambda x, y: x - y, [F.col(f"l_{a}_{b}") * s for b, s in zip(DIMENSIONS, solved)], F.col(a) - F.col(f"m_{a}"))
        return nest(i + 1, [*solved, rest / F.col(f"l_{a}_{a}")])

    return nest(0, [])


def _measured(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics with `d2`, each by its group's estimate."""
    return rows.select("row", *keys, *DIMENSIONS).join(sized_broadcast(estimate), keys).select("row", *keys, *DIMENSIONS, _distance().alias("d2"))


def _near_half(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`inside`: the half of each group with the least d2, by a quantile sketch."""
    half = stash(rows.groupBy(*keys).agg(F.percentile_approx("d2", 0.5, 10_000).alias("limit")), "half")
    return rows.join(sized_broadcast(half), keys).select("row", *keys, *DIMENSIONS, (F.col("d2") <= F.col("limit")).alias("inside"))


def _started(rows: DataFrame) -> DataFrame:
    """rows once by start, with the d2 that it begins from; a start of all texts holds all at 0."""
    centre = stash(rows.groupBy("part").agg(*[F.percentile_approx(a, 0.5, 10_000).alias(f"c_{a}") for a in DIMENSIONS]), "centre")
    off = rows.join(sized_broadcast(centre), "part").select("row", "part", *DIMENSIONS, *[F.abs(F.col(a) - F.col(f"c_{a}")).alias(f"o_{a}") for a in DIMENSIONS])
    spread = stash(off.groupBy("part").agg(*[F.greatest(1.4826 * F.percentile_approx(f"o_{a}", 0.5, 10_000), F.lit(FLOORS[a])).alias(f"r_{a}") for a in DIMENSIONS]), "spread")
    scaled = [F.pow(F.col(f"o_{a}") / F.col(f"r_{a}"), 2) for a in DIMENSIONS]
    begun = {"scaled": reduce(lambda x, y: x + y, scaled), "largest": F.greatest(*scaled), "all": F.lit(0.0)}
    starts = F.explode(F.array(*[F.struct(F.lit(n).alias("start"), begun[n].alias("d2")) for n in STARTS]))
    return off.join(sized_broadcast(spread), "part").select("row", "part", *DIMENSIONS, starts.alias("s")).select("row", "part", "s.start", *DIMENSIONS, "s.d2")


def _concentrated(rows: DataFrame) -> DataFrame:
    """The statistics with d2 by the estimate of the least determinant that the starts lead to."""
    both = ["part", "start"]
    tried = rows.select("row", "part", F.explode(F.array(*[F.lit(n) for n in STARTS])).alias("start"), *DIMENSIONS)
    now = _started(rows)
    for step in range(FIRST_STEPS):
        estimate = stash(_estimate(_near_half(now, both), both, HALF), f"start_{step}")
        now = _measured(tried, estimate, both)
    best = stash(estimate.groupBy("part").agg(F.min_by(F.struct("*"), F.struct("spread", "start")).alias("b")).select("b.*").drop("start"), "best")
    now, before = _measured(rows, best, ["part"]), best
    for step in range(MOST_STEPS):
        estimate = stash(_estimate(_near_half(now, ["part"]), ["part"], HALF), f"estimate_{step}")
        now = _measured(rows, estimate, ["part"])
        fell = before.select("part", F.col("spread").alias("old")).join(estimate.select("part", "spread"), "part").where(F.col("old") - F.col("spread") > STILL)
        before = estimate
        if fell.isEmpty():
            break
    return now


def judged(docs: DataFrame, cut: float = CHI_LAST, least_group: int = 200, **columns: str) -> DataFrame:
    """The counts of base(), base_failed, judged_by and d2 (null where the base rules fail), and kept."""
    with scratch() as keep:
        counts = keep(stash(base(docs, **columns).withColumn("row", F.monotonically_increasing_id()), "counts"))
        passed = _vector(counts.where("not base_failed"))
        key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
        passed = passed.select("row", *DIMENSIONS, key("lang").alias("l"), key("source").alias("s"))
        groups = passed.groupBy("l", "s").count()
        langs = groups.where(F.col("count") < least_group).groupBy("l").agg(F.sum("count").alias("rest"))
        part = F.when(F.col("count") >= least_group, F.concat_ws("\t", F.lit("group"), "l", "s")).when(F.col("rest") >= least_group, F.concat_ws("\t", F.lit("language"), "l")).otherwise(F.lit("all"))
        parts = stash(groups.join(langs, "l", "left").select("l", "s", part.alias("part")), "parts")
        rows = keep(stash(passed.join(sized_broadcast(parts), ["l", "s"]).select("row", "part", *DIMENSIONS), "vectors"))
        near = _concentrated(rows).withColumn("inside", F.col("d2") <= CHI_975)
        estimate = keep(stash(_estimate(near, ["part"], NEARLY_ALL), "estimate"))
    final = _measured(rows, estimate, ["part"]).select("row", F.substring_index("part", "\t", 1).alias("judged_by"), "d2")
    kept = ~F.col("base_failed") & (F.col("d2") <= cut)
    return counts.join(final, "row", "left").withColumn("kept", F.coalesce(kept, F.lit(False))).drop("row")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "judged_by", "d2")
