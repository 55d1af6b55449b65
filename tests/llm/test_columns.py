"""Stages hand on columns of any name, and rows of any content; samples are bounded."""

import pytest

import corpus_pipeline
from gridloom.llm import common, decontaminate, near, secrets, toxicity

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "__member", "a.b", "score", "kept", "m0", "label"]
KEY = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "plain words of a text", "you idiot, moron and scum " * 3, f'token = "{KEY}"', "word " * 200_000, "plain words of a text", "one two three four five six seven eight nine ten eleven"]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 0.5, 1.5, True, 7, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2]], "a long, b string, c string, d string, e long, f string, g double, h double, i boolean, j long, k string").toDF(*NAMES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def stages(spark, labels):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string")
    forest = secrets.train(secrets.labelled_findings(spark))
    return {
        "toxicity": lambda d: toxicity.without_toxic(d, toxicity.train(d, labels)),
        "simhash": near.deduplicated,
        "decontaminate": lambda d: decontaminate.without_spans(d, bench, count_col="n_chars"),
        "secrets": lambda d: secrets.redacted(d, forest, count_col="n_chars"),
    }


def test_every_stage_keeps_columns_and_what_it_does_not_reject(spark, docs, labels):
    assert [n for n, _ in corpus_pipeline.STAGES[:-1]] == list(stages(spark, labels))
    for name, stage in stages(spark, labels).items():
        out = stage(docs)
        assert out.columns == NAMES and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all((r[5], r[6], r[9]) == ("x", 0.5, 7) for r in rows), name
        ids = sorted(r[0] for r in rows if name != "toxicity" or r[0] != 3)
        assert ids == {"simhash": [0, 2, 3, 4, 5, 7], "toxicity": [0, 1, 2, 2, 4, 5, 6, 7]}.get(name, [0, 1, 2, 2, 3, 4, 5, 6, 7]), name
        text = {r[0]: r[1] for r in rows}
        if name == "decontaminate":
            assert text[7] == " eleven" and [r[4] for r in rows if r[0] == 7] == [7]
        if name == "secrets":
            assert text[4] == f'token = "{secrets.MASK}"' and text[0] is None
        assert stage(docs.limit(0)).count() == 0, name


def test_samples_are_bounded_by_rows(spark):
    same = spark.range(30_000).selectExpr("cast(null as long) as label_id", "cast(null as string) as text")
    assert common.sampled(same, 100).count() == 100
    many = spark.range(20_000).selectExpr("id as label_id", "'one text' as text")
    assert common.sampled(many, 500).select("label_id").distinct().count() == 500
    # of a table said to be a hundred thousand million rows long, about as many are drawn as its share asks for
    assert common.sampled(many, 20_000, 10**11).count() <= 5
    assert common.sampled(many, 50_000).count() == 20_000
