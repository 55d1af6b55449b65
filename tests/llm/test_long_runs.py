"""Very long runs of white space are encoded like any text, in both operators and the packing stage."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [" " * 3_000_000, " \n" * 1_000_000, "word " + "\t \n" * 500_000 + "tail", ("a" + " " * 150_000) * 3, " " * 99_999 + "x", "é" * 300_000]


def test_ids_are_the_tokenizers_own():
    own, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for text in TEXTS:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_operators_and_the_packing_stage_take_them(spark):
    sizes = [len(packing.encoder(PATH)(t)) for t in TEXTS]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    counted = token_counts.section_counts(docs, PATH).groupBy("doc_id").sum("tokens").orderBy("doc_id").collect()
    assert [r[1] for r in counted] == sizes
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r.start, r.ids) for r in pieces if r.doc_id == i)
        ids = np.frombuffer(b"".join(x for _, x in own), "<u4")
        assert ids[:-1].tolist() == packing.encoder(PATH)(text).tolist() and ids[-1] == 1
