from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, pieces, sequence_length=2048):
    tokenizer = Tokenizer.from_file(PATH)
    ids = Counter()
    for i, text in rows:
        found = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        ids[(i, found.tobytes())] += 1
    whole = defaultdict(list)
    for p in pieces:
        whole[p.doc_id].append(p)
    total = Counter()
    for i, found in whole.items():
        for p in found:
            total[(i, p.doc_tokens)] += p.length
    wanted = Counter()
    for (i, b), n in ids.items():
        wanted[(i, len(b) // 4)] += n * (len(b) // 4)
    assert total == wanted
    for (i, b), n in ids.items():
        if n == 1 and len([k for k in ids if k[0] == i]) == 1:
            parts = sorted(whole[i], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in parts) == b
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s, spans in sequences.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == sequence_length or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_documents_are_packed_once_without_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs, PATH, window_sequences=4).collect()
    check(rows, pieces)
    crc = packing.digest(packing.pack(docs, PATH)).first()
    assert 0 <= crc.ids_crc32 < 1 << 32


def test_windows_hold_the_target_proportions(spark):
    df = spark.createDataFrame([(i, "word " * 400, "a" if i % 2 else "b", 1) for i in range(200)], "doc_id long, text string, source string, start int")
    pieces = packing.pack(df, PATH, sequence_length=128, window_sequences=8, targets={"a": 0.75, "b": 0.25}).collect()
    by = defaultdict(Counter)
    for p in pieces:
        by[(p.sequence_id * 128 + p.offset) // 1024][p.queue] += p.length
    a_total = sum(c["=a"] for c in by.values())
    run = 0
    for w in sorted(by):
        run += by[w]["=a"]
        if run < a_total:
            assert abs(by[w]["=a"] - 768) <= 2 and abs(run - 768 * (w + 1)) <= 2


def test_nulls_empty_specials_and_repeated_rows(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "x<|endoftext|>y", None), (4, "same", "s"), (4, "same", "s"), (None, "t", "u"), (5, "lang " * 30_000, "s")]
    df = spark.createDataFrame([(i, t, s, 9, "q") for i, t, s in rows], "doc_id long, text string, source string, offset int, queue string")
    check([(i, t) for i, t, _ in rows], packing.pack(df, PATH).collect())
    check([(i, t) for i, t, _ in rows], packing.pack(df, PATH, max_queues=1).collect())
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_small_sources_send_whole_runs_and_keep_their_share(spark):
    rows = [(i, "word " * 1500, f"s{i % 500}") for i in range(1000)]
    df = spark.createDataFrame([*rows, (1000, "word " * 150_000, "large")], "doc_id long, text string, source string").repartition(6)
    pieces = packing.pack(df, PATH, sequence_length=1024, window_sequences=8).collect()
    check([(r.doc_id, r.text) for r in df.collect()], pieces, 1024)
    small = [p.length for p in pieces if p.queue != "=large"]
    assert np.mean(small) > 500
    # every run of windows from the start holds the sources' shares, to within an item each
    total, runs = Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.queue] += p.length
        runs[p.sequence_id // 8][p.queue] += p.length
    tokens, seen, sent = sum(total.values()), 0, Counter()
    for w in sorted(runs):
        sent.update(runs[w])
        seen += sum(runs[w].values())
        for q, n in total.items():
            assert abs(sent[q] - seen * n / tokens) <= 1024 + 0.25 * 8192
        assert abs(sum(runs[w].values()) - 8192) <= 8192


def test_thousands_of_sources_are_not_shredded(spark):
    df = spark.createDataFrame([(i, "word " * 400, f"s{i}") for i in range(2000)], "doc_id long, text string, source string")
    pieces = packing.pack(df, PATH).collect()
    assert len(pieces) < 2000 * 1.5 and sum(p.length for p in pieces) == 2000 * pieces[0].doc_tokens
