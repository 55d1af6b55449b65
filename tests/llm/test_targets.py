from collections import Counter

from gridloom.llm import packing

from .test_op2 import PATH


def test_targets_hold_beyond_max_queues(spark):
    rows = [(i, "word " * 400, "a" if i % 2 else f"other{i % 20}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, PATH, sequence_length=128, window_sequences=8, targets={"a": 0.75}, max_queues=4).collect()
    first = Counter()
    for p in pieces:
        if p.sequence_id < 80:
            first[p.queue] += p.length
    assert abs(first["=a"] / sum(first.values()) - 0.75) < 0.02 and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
