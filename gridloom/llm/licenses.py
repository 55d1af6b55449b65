"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Templates are word sequences. Of each window of `winnow` shingles (of `gram`
words) the one with the least hash is a fingerprint, in an inverted index of
(template, place). Every shingle of a whole text is looked up, so any run of
gram + winnow - 1 template words has a hit. Hits of one template that lie
on diagonals within the band of each other are one
candidate; words are then aligned inside the band around its middle diagonal
(longest common subsequence), which gives the matched words, the coverage of
the template and the span in the text. Words put in or left out move the rest
to other diagonals: hits outside full matches are joined to anchors,
chained by rising places in text and template, and what lies between two
anchors is aligned in its own band, so edits anywhere are measured alike. The
better measure of one place stays.

A candidate for a long template must have one hit for every HIT_WORDS of its
words, and a text under the coverage in words is none.

The templates are the whole texts of public licences (`licence_texts`) and
short notices. The index is a parameter of bounded size (`MOST_TEMPLATE_WORDS`); texts are
worked in blocks, each candidate by itself.

Nulls: a null text has no words. Texts without a match give no row; each
occurrence gives one, repeated rows each their own. An empty table or no
templates give no rows. Only the named columns are read.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, row_blocks

MOST_TEMPLATE_WORDS = 2_000_000
HIT_WORDS = 64
#: Cells of the largest alignment between two anchors.
MOST_TABLE = 4_000_000
#: Short notices and the openings of public licences, as their texts have them; fixed values.
NOTICES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Notices, and the whole licences by name.
TEMPLATES = NOTICES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def shingles(hashes: np.ndarray, gram: int) -> np.ndarray:
    if len(hashes) < gram:
        return np.zeros(0, np.uint64)
    out = mix(hashes[: len(hashes) - gram + 1])
    for k in range(1, gram):
        out = mix(out ^ hashes[k : len(hashes) - gram + 1 + k])
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the rightmost least hash of each window."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


class Index:
    def __init__(self, templates: dict[str, str], gram: int = 3, winnow: int = 2):
        words = Words([t.encode() for t in templates.values()])
        if len(words.starts) > MOST_TEMPLATE_WORDS:
            raise ValueError("the templates are too large to send to every task")
        hashes = words.hashes()
        self.names, self.gram = list(templates), gram
        self.words = [hashes[a:b] for a, b in zip(words.first, words.first[1:])]
        entries = []
        for t, w in enumerate(self.words):
            grams = shingles(w, gram)
            entries += [(int(grams[i]), t, int(i)) for i in winnowed(grams, winnow)]
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.template, self.place = (np.array([e[k] for e in entries], np.int64) for k in (1, 2))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, template, place in it) of every posting that a shingle meets."""
        lo, hi = np.searchsorted(self.prints, grams, "left"), np.searchsorted(self.prints, grams, "right")
        at = np.flatnonzero(hi > lo)
        counts = (hi - lo)[at]
        posting = np.repeat(lo[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum())) if len(at) else np.zeros(0, np.int64)
        return np.repeat(at, counts), self.template[posting], self.place[posting]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, behind the last) of the best common subsequence near text place = template place + diagonal."""
    n, width = len(template), 2 * band + 1
    score = np.zeros((n + 1, width + 1), np.int32)
    offsets = np.arange(width) - band + diagonal
    match = np.zeros((n, width), bool)
    for i in range(n):
        j = offsets + i
        inside = (j >= 0) & (j < len(text))
        match[i, inside] = text[j[inside]] == template[i]
        # place d of row i stands for text place i + offset; one row on, the same text place is one lower
        step = np.maximum(score[i, :width] + match[i], score[i, 1 : width + 1])
        score[i + 1, :width] = np.maximum.accumulate(step)
        score[i + 1, width] = score[i + 1, width - 1]
    i, d = n, width - 1
    total, first, last = int(score[n, width - 1]), 0, 0
    while i > 0 and d >= 0 and score[i, d] > 0:
        if d > 0 and score[i, d - 1] == score[i, d]:
            d -= 1
        elif match[i - 1, d] and score[i, d] == score[i - 1, d] + 1:
            first = i - 1 + int(offsets[d])
            last = last or first + 1
            i -= 1
        else:
            i, d = i - 1, d + 1
            if d >= width:
                d = width - 1
    return total, first, last


def anchors(where: np.ndarray, place: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word in the text, first word in the template, words) of runs of hits on one diagonal that leave no word between."""
    diagonal = where - place
    order = np.lexsort((where, diagonal))
    where, place, diagonal = where[order], place[order], diagonal[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(diagonal) != 0) | (np.diff(where) > gram)]))
    ends = np.append(starts[1:], len(where)) - 1
    return where[starts], place[starts], where[ends] + gram - where[starts]


def best_chain(x: np.ndarray, y: np.ndarray, n: np.ndarray, gram: int) -> list[int]:
    """Of anchors sorted by x, the ones that rise in text and template and hold most words; little is taken off for words between.

    An anchor may share gram - 1 words with the one before. What is taken off
    is a difference of places, so the best one before is a maximum over lower places in
    the template: a tree of maxima gives it, whatever the number of anchors.
    """
    xs, ys, ns = x.tolist(), y.tolist(), n.tolist()
    size = max(b + k for b, k in zip(ys, ns)) + 1
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, back = [0.0] * len(xs), [-1] * len(xs)
    ready = sorted(range(len(xs)), key=lambda i: xs[i] + ns[i])
    done = 0
    for j in range(len(xs)):
        while done < len(ready) and xs[ready[done]] + ns[ready[done]] - gram + 1 <= xs[j]:
            i = ready[done]
            entry, at = (score[i] + 0.01 * (xs[i] + ys[i] + 2 * ns[i]), i), ys[i] + ns[i] - gram + 2
            while at <= size:
                if entry > tree[at]:
                    tree[at] = entry
                at += at & -at
            done += 1
        best, at = (-np.inf, -1), ys[j] + 1
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - 0.01 * (xs[j] + ys[j])
        score[j], back[j] = (ns[j] + gain, best[1]) if gain > 0 else (float(ns[j]), -1)
    at, out = int(np.argmax(score)), []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def _between(template: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best common subsequence of what lies between two anchors; only anchors count where that is MOST_TABLE cells or more."""
    if not len(template) or not len(text) or len(template) * max(len(template), len(text)) > MOST_TABLE:
        return 0, 0, 0
    return align(template, text, 0, max(len(template), len(text)))


def measured(template: np.ndarray, text: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, behind the last) of a chain of anchors: their words, and the alignment of each gap, head and tail by itself."""
    slack = len(template) // 8 + 8
    head_from = max(0, int(x[0] - y[0]) - slack)
    total, first, _ = _between(template[: y[0]], text[head_from : x[0]])
    first = head_from + first if total else int(x[0])
    at_x, at_y = int(x[0]), int(y[0])
    for a, b, k in zip(x.tolist(), y.tolist(), n.tolist()):
        cut = max(0, at_x - a, at_y - b)  # words that the anchor before has, too
        a, b, k = a + cut, b + cut, k - cut
        total += _between(template[at_y:b], text[at_x:a])[0] + k
        at_x, at_y = a + k, b + k
    more, _, last = _between(template[at_y:], text[at_x : at_x + len(template) - at_y + slack])
    return total + more, first, at_x + (last if more else 0)


def chained(template: np.ndarray, text: np.ndarray, where: np.ndarray, place: np.ndarray, gram: int, coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, behind the last) of occurrences with words put in or left out anywhere.

    An occurrence is at most `span` words long, as three fifths of it match; so
    each lies in one of the windows of two spans that start a span apart. In a
    window the best chain is taken, then the best one of the rest, while enough words are left.
    """
    size, out = len(template), []
    span = int(size / 0.6) + 1
    x, y, n = anchors(where, place, gram)
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    for start in np.unique(np.concatenate([x // span, np.maximum(0, x // span - 1)])).tolist():
        left = np.flatnonzero((x >= start * span) & (x + n <= (start + 2) * span))
        while len(left) and len(np.unique(y[left])) * HIT_WORDS >= size:
            chain = left[best_chain(x[left], y[left], n[left], gram)]
            matched, first, last = measured(template, text, x[chain], y[chain], n[chain])
            if matched < coverage * size:
                break  # the others hold fewer words
            if matched >= 0.6 * (last - first):
                out.append((matched, first, last))
            left = left[(x[left] >= last) | (x[left] + n[left] <= first)] if matched >= 0.6 * (last - first) else np.setdiff1d(left, chain)
    return out


def found_in(index: Index, hashes: np.ndarray, band: int, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, behind the last) of the occurrences in one text's words.

    First by diagonals: groups of hits within the band are aligned around their
    middle. What hits are left outside those occurrences are chained.
    """
    at, template, place = index.hits(shingles(hashes, index.gram))
    out = []
    for t in np.unique(template).tolist():
        own = template == t
        where, places = at[own], place[own]
        size = len(index.words[t])
        if len(hashes) < coverage * size:
            continue
        diagonal = where - places
        order = np.lexsort((where, diagonal))
        groups, sorted_diagonal, sorted_where = np.arange(len(where)), diagonal[order], where[order]
        narrow = min(band, size // 4)  # repeats of a short template stay apart
        breaks = np.flatnonzero(np.diff(sorted_diagonal) > narrow) + 1
        seen: list[tuple[int, int, int]] = []
        for group in np.split(groups, breaks):
            if len(group) < size // HIT_WORDS:
                continue
            middle = int(np.median(sorted_diagonal[group]))
            start = max(0, middle - narrow)
            matched, first, last = align(index.words[t], hashes[start : middle + size + narrow], middle - start, narrow)
            if matched >= coverage * size and matched >= 0.6 * (last - first):
                seen.append((matched, first + start, last + start))
        # an occurrence that matches in full needs no other look; the rest may have drifted off its diagonal
        covered = np.zeros(len(where), bool)
        for matched, first, last in seen:
            if matched == size:
                covered |= (where >= first) & (where < last)
        rest = ~covered
        if rest.sum() >= max(1, size // HIT_WORDS):
            seen += chained(index.words[t], hashes, where[rest], places[rest], index.gram, coverage)
        taken: list[tuple[int, int]] = []
        for matched, first, last in sorted(seen, key=lambda o: (-o[0], o[2] - o[1], o[1])):
            most = (last - first) / 2
            if all(min(last, b) - max(first, a) <= most for a, b in taken):
                out.append((t, matched, first, last))
                taken.append((first, last))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, winnow: int = 2, band: int = 8, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence: doc_id, template, matched_words, template_words, coverage, from_char, to_char."""
    given = TEMPLATES if templates is None else templates
    Index(given, gram, winnow)  # fails early where the templates are too large

    def work(batches):
        index = Index(given, gram, winnow)
        for part, texts in row_blocks(batches, "text"):
            words = Words(texts)
            hashes = words.hashes()
            grams = shingles(hashes, gram)
            hit = np.zeros(len(hashes) + 1, np.int64)
            if len(grams) and len(index.prints):
                place = np.minimum(np.searchsorted(index.prints, grams), len(index.prints) - 1)
                hit[1 : len(grams) + 1] = np.cumsum(index.prints[place] == grams)
                hit[len(grams) + 1 :] = hit[len(grams)]
            some = np.flatnonzero(hit[words.first[1:]] > hit[words.first[:-1]])
            rows = []
            for i in some.tolist():
                a, b = int(words.first[i]), int(words.first[i + 1])
                for t, matched, first, last in found_in(index, hashes[a:b], band, coverage):
                    base = int(words.base[i])
                    chars = lambda n, base=base: len(words.data[base:n].decode())
                    rows.append((i, index.names[t], matched, len(index.words[t]), matched / len(index.words[t]), chars(int(words.starts[a + first])), chars(int(words.ends[a + last - 1]))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], ["doc_id", "template", "matched_words", "template_words", "coverage", "from_char", "to_char"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, template string, matched_words long, template_words long, coverage double, from_char long, to_char long")
