"""A training corpus from documents: each stage is one operator of gridloom.llm, over all that the last one kept.

toxicity drops documents that score toxic, simhash keeps one document of each
group of near duplicates (five-word shingles, a similarity of 0.8 or more),
decontaminate cuts benchmark passages out of the texts, secrets masks
confirmed secrets, packing cuts the tokens into sequences that mix the sources
by target proportions. All but the last return the columns of documents, and
hand on extra ones, whatever their names. A stage of no rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import common, decontaminate, near, packing, queries, secrets, toxicity
from gridloom.plans import storage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts score by the classifier's bias and stay; repeated rows go or stay alike."""
    return toxicity.without_toxic(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words, null ones too, are one group; of rows equal in id and text one stays."""
    return near.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts and an empty benchmark hit nothing."""
    return decontaminate.without_spans(docs, queries.table(spark, sf_dir, "benchmark"), count_col="n_chars")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts stay null."""
    return secrets.redacted(docs, queries.secret_forest(spark), count_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids (little-endian, unsigned, 32 bits); a null text is its end token alone."""
    return packing.pack(docs, queries.TOKENIZER, targets=queries.MIXTURE).drop("queue")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: Fingerprints, forests and tokenizers have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others wrote but for the last table is deleted as soon as the next one stands."""
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with storage.scratch() as keep:
            docs = keep(common.stash(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last is not None:
            storage.release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
