import numpy as np

from gridloom.llm import features, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels))
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.95
    assert np.mean([g >= 0.7 for g in good]) > 0.97


def test_nulls_empty_long_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "text"), (3, "some words."), (3, "some words."), (4, "word " * 200_000), (5, "x" * 100_000), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, 0.5, "a", 7) for i, t in rows], "doc_id long, text string, score double, label string, label_id int")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 1), (3, 0, 0), (6, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, some)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_statistics_of_small_texts():
    names = features.STATISTICS
    rows = [dict(zip(names, r)) for r in features.statistics([b"a b a b a b", b"", b"X!! Y!!\nX!! Y!!", "é".encode()])]
    assert np.isclose(rows[0]["distinct"], 2 / 6) and rows[1]["no_stop"] == 1 and rows[0]["next_same"] == 0
    assert rows[2]["dup_lines"] == 0.5 and rows[2]["bangs"] == 2 and rows[2]["capitals"] == 1
    assert rows[3]["high_bytes"] == 1 and all(np.isfinite(list(r.values())).all() for r in rows)


def test_non_negative_risk_separates_a_mixture():
    rnd = np.random.default_rng(4)
    positive = rnd.normal(2, 1, (8000, 2))
    unlabelled = np.concatenate([rnd.normal(2, 1, (11_200, 2)), rnd.normal(-2, 1, (4800, 2))])
    edges = quality.bin_edges(unlabelled)
    w = quality.fit(quality.binned(positive, edges), quality.binned(unlabelled, edges), 0.7, sum(len(e) + 1 for e in edges))
    z = w[quality.binned(unlabelled, edges)].sum(1) + w[-1]
    assert ((z > 0) == (np.arange(16_000) < 11_200)).mean() > 0.97


def test_prior_of_mixtures_is_found():
    rnd = np.random.default_rng(11)
    for share in (0.85, 0.5, 0.2):
        positive = rnd.normal(1.5, 1, (8000, 3))
        n = int(20_000 * share)
        unlabelled = rnd.permutation(np.concatenate([rnd.normal(1.5, 1, (n, 3)), rnd.normal(-1.5, 1, (20_000 - n, 3))]))
        edges = quality.bin_edges(np.concatenate([positive, unlabelled]))
        size = sum(len(e) + 1 for e in edges)
        good, mixed = quality.binned(positive, edges), quality.binned(unlabelled, edges)
        assert abs(quality.estimated_prior(good, mixed, size) - share) < 0.06
        w = quality.contrast(good, mixed, size)
        assert w[good].sum(1).mean() > w[mixed].sum(1).mean()
    assert quality.estimated_prior(good[:1], mixed[:1], size) == 1.0


def test_an_id_on_many_rows_is_fetched_once(spark):
    from gridloom.llm.common import one_text_an_id

    rows = [(1, f"text {i % 7}") for i in range(2000)] + [(2, None), (None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "label_id long, text string")
    got, again = (sorted(map(str, one_text_an_id(x).collect())) for x in (df, df.repartition(5)))
    assert len(got) == 3 and got == again
