import hashlib
import random
import re

import numpy as np

from gridloom.llm import decontaminate
from gridloom.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[i : i + n])):
                    hit |= {*range(i, i + n)}
                    found |= own
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def same(got, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def test_documents_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[-1] for r in expected)
    same(decontaminate.digest(decontaminate.contamination(docs, items)).collect(), expected)
    same(decontaminate.digest(decontaminate.contamination(docs, items, part_bytes=3000)).collect(), expected)


def test_small_alphabet_short_items_nulls_and_ties(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "B", "c", "é"]) + rnd.choice([" ", ", ", "\n"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    docs = [*enumerate(texts), (3, None), (4, ""), (5, "..."), (None, "a a a"), (7, "a b"), (7, "a b"), (9, "a b c d " * 30_000)]
    items = [(1, "a b"), (2, "A, B"), (3, None), (4, ""), (5, "é c a b a é é c a b b"), (None, "c c"), (6, "zzz"), (7, " ".join("abcabcabcabcabc"))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, spans int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.digest(decontaminate.contamination(d, b, window=4)).collect(), brute(docs, items, 4))
    same(decontaminate.digest(decontaminate.contamination(d, b, window=4, part_bytes=100)).collect(), brute(docs, items, 4))
    assert decontaminate.contamination(d, b.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    cut = decontaminate.without_spans(d, b, window=4)
    assert cut.columns == d.columns and cut.count() == len(docs)
    assert {r.text for r in cut.where("doc_id = 7 and items = 'x'").collect()} >= {""}


def test_spans_are_cut_from_whole_characters(spark):
    d = spark.createDataFrame([(1, "Ünd dann: das Üble Spiel, ÉTÉ — fertig!"), (2, "nichts")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Das Üble spiel")], "item_id long, text string")
    assert [r.text for r in decontaminate.without_spans(d, b).orderBy("doc_id").collect()] == ["Ünd dann: , ÉTÉ — fertig!", "nichts"]


def test_index_orders_counts_and_locates():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n, sigma = int(rnd.integers(1, 80)), int(rnd.integers(2, 6))
        text = rnd.integers(0, sigma, n)

        def key(i, text=text, n=n):
            out = []
            while i < n and text[i]:
                out.append((int(text[i]), 0))
                i += 1
            return [*out, (0, i)]

        assert list(suffix_order(text, sigma)) == sorted(range(n), key=key)
        index = FMIndex(text, sigma, 3)
        patterns = [tuple(rnd.integers(1, sigma, rnd.integers(1, 5))) for _ in range(8)]
        table = np.zeros((8, 4), int)
        for k, p in enumerate(patterns):
            table[k, 4 - len(p) :] = p
        lo, hi = index.search(table, np.array([len(p) for p in patterns]))
        for k, p in enumerate(patterns):
            assert sorted(index.locate(np.arange(lo[k], hi[k]))) == [i for i in range(n - len(p) + 1) if tuple(text[i : i + len(p)]) == p]


def test_phrases_of_a_part_are_small_arrays():
    import tracemalloc

    rnd = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(60_000)])
    rows = [(i, " ".join(vocabulary[rnd.integers(0, len(vocabulary), 400)])) for i in range(3400)]
    assert sum(len(t) for _, t in rows) > 8_000_000
    tracemalloc.start()
    phrases = decontaminate.Phrases(rows, 10)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(phrases.patterns) == 3400 * 391 and held < 150e6 and most < 800e6


def test_windows_of_several_items_and_short_ones():
    phrases = decontaminate.Phrases([(7, "a b c d"), (3, "x b c d"), (None, "b c d"), (5, "a b"), (9, "a b"), (4, None)], 3)
    text = {tuple(p[p > 0].tolist()): phrases.items[a:b].tolist() for p, a, b in zip(phrases.patterns, phrases.first, phrases.first[1:])}
    symbol = {w: int(np.searchsorted(phrases.vocabulary, decontaminate.Words([w.encode()]).hashes()[0])) + 1 for w in "abcdx"}
    of = lambda s: tuple(symbol[w] for w in s.split())
    assert text == {of("a b c"): [7], of("b c d"): [3, 7], of("x b c"): [3], of("a b"): [5, 9]}


def test_many_parts_agree_with_one(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(120))) for _ in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 40)))) for i in range(400)]
    d = spark.createDataFrame([*enumerate(texts), (5, texts[6]), (None, texts[7])], "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) + 32 for _, t in items)
    many = decontaminate.contamination(d, b, window=3, part_bytes=-(-size // 64))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_words, str(r.spans))
    one = decontaminate.contamination(d, b, window=3)
    assert sorted(many.collect(), key=key) == sorted(one.collect(), key=key)
    cut = lambda n: sorted((r.doc_id or -1, r.text) for r in decontaminate.without_spans(d, b, 3, n).collect())
    assert cut(-(-size // 7)) == cut(8 << 20)
