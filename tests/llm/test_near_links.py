"""The near-dedup of the pipeline against links of all pairs."""

import random

from gridloom.llm import near

from .test_pipeline import links_brute, smallest


def word(rnd):
    return "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 7)))


def edited(rnd, words, places):
    out = list(words)
    for i in places:
        out[i] = word(rnd) + "z"
    return out


def compared(spark, rows):
    low, links = links_brute(rows)
    got = sorted(r.doc_id for r in near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    same = {}
    for i, _ in sorted(rows):
        same.setdefault(low[i], i)
    want = sorted(smallest(low, {(same[low[i]], i) for i in low} | links))
    return got, want, links


def test_large_groups_of_copies_unlike_each_other(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(2):
        base = [word(rnd) for _ in range(400)]
        # eight single words of 400 changed: 0.82 like the base, under 0.8 to most of each other
        rows += [(1000 * g + c, " ".join(edited(rnd, base, [rnd.randrange(5) + 50 * k + 5 * (c % 9) for k in range(8)]))) for c in range(300)]
        # the second group has no original: some copies link to none
        rows += [(1000 * g + 999, " ".join(base))] if g == 0 else []
    got, want, links = compared(spark, rows)
    assert sum(a < 1000 and b == 999 for a, b in links) == 300 and sum(b < 999 for _, b in links) < 300 * 299 / 4
    assert got == want and sum(i < 1000 for i in got) == 1


def test_pairs_at_the_similarity_are_all_found(spark):
    rnd = random.Random(8)
    rows = []
    for g in range(150):
        base = [word(rnd) for _ in range(rnd.choice((12, 60, 300, 1000)))]
        n = len(base)
        rows.append((10 * g, " ".join(base)))
        for c, share in enumerate((0.015, 0.02, 0.024), 1):
            rows.append((10 * g + c, " ".join(edited(rnd, base, rnd.sample(range(n), max(1, int(share * n)))))))
        rows.append((10 * g + 4, " ".join(base + [word(rnd) for _ in range(n // 4 - 1)])))
    got, want, links = compared(spark, rows)
    assert len(links) > 300 and got == want


def test_a_line_repeated_more_often_is_a_near_copy(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(30):
        lines = [" ".join(word(rnd) for _ in range(12)) for _ in range(25)]
        rows += [(10 * g + c, "\n".join(lines + lines[3:4] * times)) for c, times in enumerate((1, 3, 4, 9, 40))]
    got, want, _ = compared(spark, rows)
    assert got == want == [10 * g for g in range(30)]


def test_documents_against_links_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, want, links = compared(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert links and got == want
