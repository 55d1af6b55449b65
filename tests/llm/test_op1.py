import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text, rule):
    """From the tokenizer's ids and a byte-by-byte count."""
    data = (text or "").encode()
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    owner, section = [], 0
    for i, b in enumerate(data):
        owner.append(section)
        section += b == 10 and i + 1 < len(data)
    counts, crossing, at = defaultdict(float), Counter(), 0
    sizes = token_counts.token_bytes(PATH)
    for t in ids:
        own = Counter(owner[at : at + sizes[t]])
        at += int(sizes[t])
        if rule == "share":
            for s, n in own.items():
                counts[s] += n / sum(own.values())
                crossing[s] += len(own) > 1
        else:
            s = min(own) if rule == "start" else min(own, key=lambda s: (-own[s], s))
            counts[s] += 1
            crossing[s] += len(own) > 1
    assert at == len(data)
    return [(s, round(counts[s], 6), crossing[s], len(ids)) for s in range((owner[-1] if owner else 0) + 1)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_brute_force(spark, sf, rule):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "\n", "\n\n", " ", "é", "𝄞", "word", "  \n", "<|endoftext|>", "日本"]) for _ in range(rnd.randrange(40))) for _ in range(120)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in token_counts.section_counts(df, PATH, rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.section, round(r.tokens, 6), r.crossing, r.doc_tokens))
    for i, t in enumerate(texts):
        assert got[i] == brute(t, rule), t


def test_spans_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "x\ny"), (3, "é\nb"), (3, "é\nb"), (4, "line of text\n" * 20_000)]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, section int, tokens double")
    got = token_counts.section_counts(df, PATH).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, None: 2, 3: 4, 4: 20_000}
    assert {(r.from_char, r.to_char) for r in got if r.doc_id == 3} == {(0, 2), (2, 3)}
    assert {(r.tokens, r.doc_tokens) for r in got if r.doc_id in (1, 2)} == {(0.0, 0)}
    assert token_counts.section_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_counts(df, PATH, "other")
