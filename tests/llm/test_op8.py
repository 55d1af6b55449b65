import numpy as np

from gridloom.llm import label_model, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(toxicity.score(docs, toxicity.train(docs, labels)))
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out("doc_id", 3, 1)
    flipped = labels.selectExpr("doc_id", "quality", "toxic").withColumn("toxic", (1 - labels.toxic).cast("int")).where(out).union(labels.where(~out))
    a, b = (sorted(map(tuple, toxicity.digest(toxicity.score(docs, toxicity.train(docs, x))).collect())) for x in (labels, flipped))
    assert a == b


def test_nulls_empty_long_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "you idiot, moron and scum"), (3, "fine words"), (4, "word " * 200_000), (5, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "a", 7) for i, t in rows], "doc_id long, text string, score double, label string, predicted int")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 1), (3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.digest(toxicity.score(docs, toxicity.train(docs, some))).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_label_model_finds_accuracies_and_a_correlation():
    rnd = np.random.default_rng(2)
    y = rnd.random(20_000) < 0.2
    vote = lambda hit, alarm: (rnd.random(len(y)) < np.where(y, hit, alarm)).astype(int)
    votes = np.stack([vote(0.9, 0.05), vote(0.7, 0.1), vote(0.8, 0.02), vote(0.6, 0.05)], 1)
    votes = np.concatenate([votes, votes[:, 3:] ^ (rnd.random((len(y), 1)) < 0.02)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found, model = label_model.fit(patterns, counts.astype(float), 0.2)
    assert {3, 4} in [{i, p} for i, p in enumerate(model["parents"])]
    for (alarm, hit), (h, a) in zip(label_model.accuracies(model), [(0.9, 0.05), (0.7, 0.1), (0.8, 0.02), (0.6, 0.05)]):
        assert abs(hit - h) < 0.08 and abs(alarm - a) < 0.05
    assert ((found[inverse] > 0.5) == y).mean() > 0.95


def test_anchors_tell_which_lone_voter_errs():
    rnd = np.random.default_rng(4)
    y = rnd.random(40_000) < 0.1
    vote = lambda hit, alarm: (rnd.random(len(y)) < np.where(y, hit, alarm)).astype(int)
    votes = np.stack([vote(0.5, 0.001), vote(0.5, 0.001), vote(0.01, 0.05)], 1)
    known = np.where(rnd.random(len(y)) < 0.2, y.astype(int), -1)
    both, inverse, counts = np.unique(np.concatenate([votes, known[:, None]], 1), axis=0, return_inverse=True, return_counts=True)
    found, _ = label_model.fit(both[:, :3], counts.astype(float), 0.1, both[:, 3])
    sure = found[inverse] >= 0.7
    assert sure[votes[:, :2].any(1) & y].all() and not sure[(votes[:, 2] == 1) & ~votes[:, :2].any(1)].any()
