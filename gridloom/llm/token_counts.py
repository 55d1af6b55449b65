"""Token counts by offset-mapped attribution.

Every whole text is encoded once. Tokens of a byte-level vocabulary lie end to
end, so the lengths of their bytes give each token's span; sections (lines by
default) are spans of the same text, and an interval join of the two sorted
lists pairs each token with all sections that it overlaps. A token inside one
section counts there. One that crosses borders is allocated by the rule:

- overlap: to the section that holds most of its bytes, the earlier at a tie;
- start: to the section that holds its first byte;
- share: to each by its share of the bytes, so counts are fractions.

By any rule the counts of a text's sections add up to its tokens.

Nulls: a null text is empty; an empty text is one empty section of no tokens.
Every repeated row is counted; an empty table gives no rows. Only the named
columns are read. Long texts are encoded whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_blocks
from .packing import encoder

RULES = ("overlap", "start", "share")


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    out = np.zeros(1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))]), np.int64)
    for token, i in model["model"]["vocab"].items():
        out[i] = len(token)
    for t in model.get("added_tokens", []):
        out[t["id"]] = len(t["content"].encode())
    return out


def line_starts(text: bytes) -> np.ndarray:
    """Where sections begin: at the start and behind each line break that something follows."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(text)]]).astype(np.int64)


def attribute(lengths: np.ndarray, starts: np.ndarray, size: int, rule: str = "overlap") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, crossing tokens allocated to it) for tokens of so many bytes, end to end."""
    ends = np.append(starts[1:], size)
    to = np.cumsum(lengths)
    at = to - lengths
    first = np.searchsorted(starts, at, side="right") - 1
    last = np.maximum(first, np.searchsorted(starts, to, side="left") - 1)
    crossing = last > first
    if rule == "start" or not crossing.any():
        chosen = np.bincount(first, minlength=len(starts)).astype(float)
        return chosen, np.bincount(first[crossing], minlength=len(starts))
    counts = np.bincount(first[~crossing], minlength=len(starts)).astype(float)
    token = np.flatnonzero(crossing)
    width = last[token] - first[token] + 1
    owner = np.repeat(np.arange(len(token)), width)
    section = np.repeat(first[token] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
    overlap = np.minimum(to[token][owner], ends[section]) - np.maximum(at[token][owner], starts[section])
    if rule == "share":
        np.add.at(counts, section, overlap / lengths[token][owner])
        return counts, np.bincount(section, minlength=len(starts))
    order = np.lexsort((section, -overlap, owner))
    best = section[order[np.concatenate([[0], np.cumsum(width)[:-1]])]]
    extra = np.bincount(best, minlength=len(starts))
    return counts + extra, extra


def section_counts(docs: DataFrame, tokenizer_path: str, rule: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section, from_char, to_char, tokens, crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def work(batches):
        encode, sizes = encoder(tokenizer_path), token_bytes(tokenizer_path)
        for part, texts in row_blocks(batches, "text", 1 << 21):
            ids = part.column(0).to_pylist()
            columns: list[list] = [[] for _ in range(7)]
            for doc, text in zip(ids, texts):
                lengths = sizes[encode(text.decode())]
                starts = line_starts(text)
                counts, crossing = attribute(lengths, starts, len(text), rule)
                whole = np.zeros(len(text) + 1, np.int64)
                np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=whole[1:])
                borders = whole[np.append(starts, len(text))]
                n = len(starts)
                for c, v in zip(columns, (None, np.arange(n), borders[:-1], borders[1:], counts, crossing, np.full(n, len(lengths)))):
                    c.append(v)
                columns[0][-1] = pa.array([doc] * n, pa.int64())
            arrays = [pa.concat_arrays(columns[0]) if columns[0] else pa.array([], pa.int64())]
            arrays += [pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns[1:], (np.int64, np.int64, np.int64, np.float64, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "from_char", "to_char", "tokens", "crossing", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, section long, from_char long, to_char long, tokens double, crossing long, doc_tokens long")
