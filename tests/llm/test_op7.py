import random
import re

import numpy as np

from gridloom.llm import licenses
from gridloom.llm.common import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_documents_against_whole_template_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    low = lambda t: WORD.findall((t or "").lower())
    expected = set()
    for r in docs.collect():
        w = low(r.text)
        for name, t in licenses.TEMPLATES.items():
            own = low(t)
            expected |= {(r.doc_id, name) for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own}
    got = licenses.scan(docs).collect()
    assert expected and {(r.doc_id, r.template) for r in got if r.coverage == 1} == expected
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.coverage == 1:
            assert low(text[r.doc_id][r.from_char : r.to_char]) == low(licenses.TEMPLATES[r.template])


def test_changed_long_templates_are_aligned(spark):
    rnd = random.Random(6)
    words = licenses.TEMPLATES["MIT permission"].split()
    rows = []
    for i in range(40):
        w = list(words)
        for _ in range(4):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], ["changed"], [w[k], "added"]])
        rows.append((i, "Vorwort é " + " ".join(w) + " end. " + " ".join(w)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for i in range(40)} == {r.doc_id for r in got} and len(got) == 80
    assert all(r.template == "MIT permission" and r.coverage > 0.85 for r in got)


def test_alignment_against_a_full_table():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b = rnd.integers(0, 4, rnd.integers(1, 12)), rnd.integers(0, 4, rnd.integers(1, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        matched, first, last = licenses.align(a.astype(np.uint64), b.astype(np.uint64), 0, 30)
        assert matched == table[-1, -1] and (not matched or 0 <= first < last <= len(b))


def test_winnowing_covers_every_window():
    rnd = np.random.default_rng(4)
    for _ in range(100):
        grams = rnd.integers(0, 9, rnd.integers(1, 30)).astype(np.uint64)
        found = set(licenses.winnowed(grams, 4).tolist())
        assert all(found & {*range(i, i + 4)} for i in range(max(1, len(grams) - 3)))
    assert len(licenses.shingles(Words([b"a b"]).hashes(), 3)) == 0


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    line = licenses.TEMPLATES["MIT notice"]
    rows = [(1, None), (2, ""), (None, line), (3, f"{line}\n{line}"), (3, f"{line}\n{line}"), (4, "word " * 200_000 + line), (5, "clean text of no licence")]
    df = spark.createDataFrame([(i, t, "x", 0.1) for i, t in rows], "doc_id long, text string, template string, coverage double")
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 3, 3, 3, 3, 4] and all(r.coverage == 1 for r in got)
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {}).count() == 0


def test_whole_licences_are_found_and_notices_are_not_them(spark):
    apache, gpl = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["GPL-3"]
    rnd = random.Random(2)
    w = gpl.split()
    for _ in range(120):
        w[rnd.randrange(len(w))] = "changed"
    rows = [(1, "Intro text.\n" + apache), (2, " ".join(w) + " end"), (3, apache[:2000]), (4, "This work is licensed under the GNU General Public License, version 3. " * 30)]
    got = {(r.doc_id, r.template): r.coverage for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "Apache-2.0"] == 1 and 0.9 < got[2, "GPL-3"] < 1
    assert not [k for k in got if k[0] in (3, 4) and k[1] in ("Apache-2.0", "GPL-3", "GPL-2", "LGPL-3")]


def full_table(a, b):
    """Longest common subsequence by the whole table."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = np.maximum(row, np.concatenate([[0], np.where(b == x, row[:-1] + 1, 0)]))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def test_words_put_in_left_out_and_lost_paragraphs(spark):
    """Coverage is that of a full table over the occurrence, and the span holds the licence alone."""
    rnd = random.Random(9)
    low = lambda t: WORD.findall(t.lower())
    cases, rows = {}, []

    def add(name, words, least):
        text = "Intro of another kind. " * 5 + " ".join(words) + " and an outro that is none." * 5
        cases[len(rows)] = (name, text, least)
        rows.append((len(rows), text))

    for name, many in (("Apache-2.0", 80), ("MIT", 12), ("Apache-2.0", 15), ("GPL-3", 200)):
        if name not in licenses.TEMPLATES:
            name = next(n for n in licenses.TEMPLATES if n.startswith(name))
        words = licenses.TEMPLATES[name].split()
        put = list(words)
        for _ in range(many):
            put.insert(rnd.randrange(1, len(put)), "zzinserted")
        add(name, put, 1.0)
        gone = list(words)
        for _ in range(many // 2):
            del gone[rnd.randrange(1, len(gone) - 1)]
        add(name, gone, 0.8)
        k = len(words) // 3
        add(name, words[:k] + words[k + len(words) // 7 :], 0.8)  # a paragraph lost
        add(name, words[:k] + ["own"] * 12 + words[k:], 1.0)  # words in one place
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.template), []).append(r)
    for i, (name, text, least) in cases.items():
        (r,) = got[i, name]
        template, words = np.array(low(licenses.TEMPLATES[name])), np.array(low(text))
        assert r.coverage >= least and abs(r.matched_words - full_table(template, words)) <= 0.01 * len(template), (i, name, r.coverage)
        assert "Intro of" not in text[r.from_char : r.to_char] and "outro that is" not in text[r.from_char : r.to_char]


def test_edited_copies_in_a_row_stay_apart(spark):
    name = next(n for n in licenses.TEMPLATES if n.startswith("MIT") and len(licenses.TEMPLATES[n].split()) > 100)
    words = licenses.TEMPLATES[name].split()
    edited = words[:50] + ["own"] * 15 + words[50:]
    text = " ".join((edited + ["between"] * 3) * 40)
    got = [r for r in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if r.template == name]
    assert len(got) == 40 and all(r.coverage == 1 for r in got) and len({r.from_char for r in got}) == 40


def test_a_phrase_of_a_licence_very_often_is_no_licence(spark):
    """Each of its words meets many places of the template; the time must not grow with the square."""
    text = "under the terms of the GNU General Public License as published by the Free Software Foundation " * 4000
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert not [r for r in got if len(licenses.TEMPLATES[r.template].split()) > 200]
