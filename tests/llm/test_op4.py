import random
import re
from collections import Counter

import numpy as np

from gridloom.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered |= {*range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def base_of(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_counts_against_brute_force_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = outliers.digest(outliers.judged(docs)).collect()
    assert len(got) == len(text)
    for r in got:
        assert base_of(r) == brute(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    passed = [r for r in got if not r.base_failed]
    assert all(r.kept for r in passed if quality.get(r.doc_id) == 1)
    bad = [r for r in passed if quality.get(r.doc_id) == 0]
    assert sum(not r.kept for r in bad) > 0.5 * len(bad)


def test_small_alphabets_nulls_long_texts_and_clashing_columns(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abé") * rnd.randrange(1, 3) + rnd.choice([" ", "\n", "\t ", " | ", "\x0b", " "]) for _ in range(rnd.randrange(80))) for _ in range(80)]
    rows = [*enumerate(texts), (1, None), (2, ""), (3, " \n"), (None, "x y"), (4, "a b c d e " * 20_000), (5, "z" * 100_000), (6, "same line\nsame line\n\n\nsame line"), (6, "same line\nsame line\n\n\nsame line")]
    df = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", k, "q", 0.1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, row int, part string, d2 double")
    got = outliers.digest(outliers.judged(df, least_group=5)).collect()
    assert Counter((r.doc_id, *base_of(r)) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    assert outliers.judged(df.limit(0)).count() == 0


def test_planted_outliers_do_not_hide_each_other(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    good = [(i, " ".join(word() for _ in range(rnd.randrange(80, 200)))) for i in range(300)]
    bad = [(1000 + i, " ".join(word() + rnd.choice(["###", "&&&"]) for _ in range(100))) for i in range(90)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in good + bad], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in outliers.judged(df).where("kept").collect()}
    assert kept == {i for i, _ in good}


def mcd(x, floors, cut):
    """The same estimate in plain numpy, with exact medians: squared distances of all rows."""
    floor = np.diag(np.array(floors) ** 2)

    def estimate(part, factor):
        return part.mean(0), np.cov(part.T, bias=True) * factor + floor

    def distance(mean, cover):
        off = x - mean
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cover), off)

    half = lambda d: d <= np.sort(d)[(len(d) - 1) // 2]
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    off = np.abs(x - low(x))
    scaled = (off / np.maximum(1.4826 * low(off), floors)) ** 2
    found = []
    for d in (scaled.sum(1), scaled.max(1), np.zeros(len(x))):
        for _ in range(2):
            mean, cover = estimate(x[half(d)], outliers.HALF)
            d = distance(mean, cover)
        found.append((np.linalg.slogdet(cover)[1], d))
    spread, d = min(found, key=lambda f: f[0])
    while True:
        mean, cover = estimate(x[half(d)], outliers.HALF)
        d, now = distance(mean, cover), np.linalg.slogdet(cover)[1]
        if spread - now <= outliers.STILL:
            break
        spread = now
    return distance(*estimate(x[d <= outliers.CHI_975], outliers.NEARLY_ALL))


def test_verdicts_against_plain_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = outliers.judged(docs, least_group=14).toPandas()
    judged = found[~found.base_failed]
    assert set(judged.judged_by) == {"group", "language"} and found[found.base_failed].judged_by.isna().all()
    n = np.maximum(judged.n_words, 1)
    x = np.stack([np.log1p(judged.n_words), np.log1p(judged.word_chars / n), np.sqrt(judged.n_symbols / np.maximum(judged.word_chars, 1)), np.sqrt(judged.n_dup_lines / np.maximum(judged.n_lines, 1)), np.sqrt(judged.n_repeat_words / n)], 1)
    groups = judged.groupby(["lang", "source"]).lang.transform("size") >= 14
    part = np.where(groups, judged.lang + " " + judged.source, judged.lang)
    assert (groups == (judged.judged_by == "group")).all()
    floors, worst = list(outliers.FLOORS.values()), 0
    for p in np.unique(part):
        own = part == p
        d = mcd(x[own], floors, outliers.CHI_LAST)
        worst = max(worst, np.abs(d / np.maximum(judged.d2[own], 1e-9) - 1).max())
        assert ((d <= outliers.CHI_LAST) == judged.kept[own]).all()
    assert worst < 0.05


def test_factors_of_a_normal_sample():
    assert abs(outliers.chi_square(outliers.CHI_MEDIAN, 5) - 0.5) < 1e-4 and abs(outliers.chi_square(outliers.CHI_975, 5) - 0.975) < 1e-4
    x = np.random.default_rng(1).normal(size=(200_000, 5))
    d = (x**2).sum(1)
    for factor, cut in ((outliers.HALF, outliers.CHI_MEDIAN), (outliers.NEARLY_ALL, outliers.CHI_975)):
        assert abs(x[d <= cut].var(0).mean() * factor - 1) < 0.02
