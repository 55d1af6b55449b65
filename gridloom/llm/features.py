"""Vectorised features of whole texts: word and stem hashes, and surface statistics."""

from __future__ import annotations

import numpy as np

from .common import SOLID, Words, mix

#: Byte lengths of the word beginnings that count as stems.
STEMS = (5, 6, 7, 8)
_MASK = {k: np.uint64((1 << (8 * k)) - 1 if k < 8 else 0xFFFFFFFFFFFFFFFF) for k in STEMS}


def stem_hash(first_bytes: np.ndarray, k: int) -> np.ndarray:
    return mix((first_bytes & _MASK[k]) ^ mix(np.full(1, 1000 + k, np.uint64)))


def terms(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, place of the word) of all words, then of the stems of each length that longer words have."""
    view = np.ndarray((len(words.raw) - 7,), "<u8", words.raw, strides=(1,))
    length = words.ends - words.starts
    out = [(words.hashes(), np.arange(len(length)))]
    for k in STEMS:
        at = np.flatnonzero(length > k)
        out.append((stem_hash(view[words.starts[at]], k), at))
    return out


def text_of_words(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def word_terms(tokens: list[str]) -> np.ndarray:
    """Hashes of given words, as texts of their own would have them."""
    return Words([t.encode() for t in tokens]).hashes() if tokens else np.zeros(0, np.uint64)


def known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 for what it doesn't hold."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(text: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Number of distinct hashes in each text."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(t[new], minlength=texts)


STATISTICS = ("log_words", "word_bytes", "distinct", "next_same", "repeat_3", "symbols", "pipes", "bangs", "digits", "capitals", "dots", "commas", "high_bytes", "dup_lines", "line_words", "one_letter", "long_words", "no_stop")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row a text, one column a name of STATISTICS."""
    words = Words(texts, SOLID, lower=False)
    n, first = len(texts), words.first
    text = text_of_words(words)
    count = np.diff(first)
    some = np.maximum(count, 1)
    raw = words.raw[: len(words.data)]
    base = np.minimum(words.base, len(raw))
    size = np.maximum(np.diff(words.base) - 1, 1)
    length = words.ends - words.starts
    h = words.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    three = h.copy()
    if len(h) > 2:
        three[:-2] = mix(mix(mix(h[:-2]) ^ h[1:-1]) ^ h[2:])
        three[-2:] = mix(h[-2:])
    lower = LOWER_CASE[raw]
    upper = UPPER_CASE[raw]
    letters = np.maximum(_per_text(lower | upper, base), 1)
    lines = Words(texts, NOT_BREAK, lower=False)
    line_text, line_count = text_of_words(lines), np.diff(lines.first)
    per_byte = lambda table: _per_text(table[raw], base)
    rows = [
        np.log1p(count),
        _per_text(length, first) / some,
        _distinct(text, h, n) / some,
        _per_text(same, first) / some,
        1 - _distinct(text, three, n) / some,
        per_byte(SYMBOLS) / some,
        per_byte(_only(b"|")) / some,
        per_byte(_only(b"!")) / some,
        per_byte(_only(b"0123456789")) / size,
        _per_text(upper, base) / letters,
        per_byte(_only(b".")) / some,
        per_byte(_only(b",")) / some,
        per_byte(HIGH) / size,
        1 - _distinct(line_text, lines.hashes(), n) / np.maximum(line_count, 1),
        np.log1p(count / np.maximum(line_count, 1)),
        _per_text(length <= 1, first) / some,
        _per_text(length > 15, first) / some,
        (count == 0).astype(float),
    ]
    return np.stack([np.asarray(r, float) for r in rows], axis=1) if n else np.zeros((0, len(STATISTICS)))


def _only(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


LOWER_CASE, UPPER_CASE, HIGH = (np.zeros(256, bool) for _ in range(3))
LOWER_CASE[97:123] = UPPER_CASE[65:91] = HIGH[128:] = True
SYMBOLS = _only(b"#*$%&|<>")
NOT_BREAK = ~_only(b"\n")
