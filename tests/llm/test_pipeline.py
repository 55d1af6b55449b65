import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from gridloom.llm import near, queries, secrets, toxicity

from .test_op2 import check as check_packing
from .test_op9 import WORD, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage gets and returns."""
    out, docs = {}, queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        after = spark.createDataFrame(after.toPandas(), after.schema) if name != "packing" else after
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_and_registration(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "secrets", "packing"]
    assert "pipeline" in __spark_entry__.queries()
    assert all(after.columns == COLUMNS for name, (_, after) in stages.items() if name != "packing")


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages["toxicity"]
    scored = toxicity.score(before, toxicity.train(before, queries.table(spark, sf, "labels")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}


def links_brute(rows, similarity=0.8):
    """(words of each id, links of different texts by shared five-word shingles)."""
    low = {i: tuple((t or "").encode().lower().split()) for i, t in rows}
    grams = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in low.items()}
    met, links = {}, set()
    for i in low:
        for g in grams[i]:
            met.setdefault(g, []).append(i)
    for i in low:
        shared = Counter(j for g in grams[i] for j in met[g] if j < i)
        links |= {(j, i) for j, n in shared.items() if low[i] != low[j] and n >= similarity * len(grams[i] | grams[j])}
    return low, links


def smallest(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {i for i in ids if root[i] == i}


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash"]
    text = {r.doc_id: r.text for r in before.collect()}
    low, links = links_brute(list(text.items()))
    same = {}
    for i in sorted(text):
        same.setdefault(low[i], i)
    copies = {(same[low[i]], i) for i in text}
    kept = {r.doc_id: r.text for r in after.collect()}
    assert all(text[i] == t for i, t in kept.items()) and len(kept) < len(text)
    # never less than one of each group, never two of the same words
    assert set(kept) >= smallest(text, copies | links)
    assert set(kept) <= smallest(text, copies)


def test_most_near_copies_go_and_others_stay(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 7)))
    rows, groups = [], {}
    for g in range(60):
        original = [word() for _ in range(300)]
        for c in range(4):
            w = list(original)
            for _ in range(c):
                w[rnd.randrange(300)] = word()
            groups[10 * g + c] = g
            rows.append((10 * g + c, " ".join(w)))
    kept = {r.doc_id for r in near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {groups[i] for i in kept} == set(range(60)) and len(kept) <= 66
    assert {10 * g for g in range(60)} <= kept


def test_copies_nulls_and_repeated_rows(spark):
    long = "word%d other%d thing%d " * 40 % tuple(range(120))
    rows = [(1, long), (2, long.upper()), (3, long + "more"), (4, long), (4, long), (5, None), (6, ""), (7, " "), (8, "short text"), (9, "quite another short text"), (None, long), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, member string")
    out = near.deduplicated(df)
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == [(1, long), (5, None), (8, "short text"), (9, "quite another short text")] and out.columns == df.columns
    assert near.deduplicated(df.limit(0)).count() == 0


def test_benchmark_passages_are_cut_out(spark, sf, stages):
    before, after = stages["decontaminate"]
    windows = set()
    for r in queries.table(spark, sf, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    new = {r.doc_id: r for r in after.collect()}
    assert len(new) == before.count()
    changed = 0
    for r in before.collect():
        spans = [(m.start(), m.end()) for m in WORD.finditer((r.text or "").lower())]
        low = words(r.text)
        hit = set()
        for n in sizes:
            for i in range(len(low) - n + 1):
                if tuple(low[i : i + n]) in windows:
                    hit |= {*range(i, i + n)}
        runs, text = [], r.text
        for i in sorted(hit):
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for a, b in reversed(runs):
            text = text[: spans[a][0]] + text[spans[b][1] :]
        assert new[r.doc_id].text == text and new[r.doc_id].n_chars == (len(text) if runs else r.n_chars)
        changed += bool(runs)
    assert changed


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    new = {r.doc_id: r for r in after.collect()}
    key = re.compile(r"(?i)token = \"([0-9a-f]{40})\"")
    masked = 0
    for r in before.collect():
        want = key.sub(lambda m: m[0].replace(m[1], secrets.MASK), r.text or "")
        assert new[r.doc_id].text == want and new[r.doc_id].n_chars == (len(want) if want != r.text else r.n_chars)
        masked += want != r.text
    assert masked and len(new) == before.count()


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    check_packing([(r.doc_id, r.text) for r in before.collect()], after.collect())
