"""What several operators share: shared storage, row blocks, word spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, release  # noqa: F401

#: Bytes of text that one vectorised step in a worker holds at a time (a longer single text is one step).
BLOCK_BYTES = 2 << 20


def stash(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts the lineage, survives lost executors."""
    return cut(df, name)


def sized_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table marked for broadcast if it has at most so many rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def sampled(docs: DataFrame, rows: int, total: int | None = None) -> DataFrame:
    """At most `rows` rows, any as likely as another, whatever the number of rows or of equal ones.

    A row's number takes part in its hash, so equal rows are drawn apart; a
    share of the hashes a little over what is asked for is cut to the least.
    """
    total = docs.count() if total is None else total
    if total <= rows:
        return docs
    names = docs.columns
    draw = F.xxhash64(*docs.columns, F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = docs.select(*names, draw.alias("__draw")).where(F.col("__draw") < (1.2 * rows + 100) / total)
    return drawn.orderBy("__draw").limit(rows).select(*names)


def one_text_an_id(rows: DataFrame, id_col: str = "label_id", text_col: str = "text") -> DataFrame:
    """The id and one text of each id, by the least hash: however often an id stands, one row of it is fetched."""
    return rows.groupBy(id_col).agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col))


def row_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text, and those texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary())
        lengths = pc.binary_length(column).fill_null(0)
        first = size = 0
        for i, n in enumerate([*lengths.to_pylist(), None]):
            if i > first and (n is None or size + n > limit):
                yield batch.slice(first, i - first), [x or b"" for x in column.slice(first, i - first).to_pylist()]
                first, size = i, 0
            size += n or 0


#: Byte classes and case for words of digits, letters and all bytes of non-ASCII characters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
#: All but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of texts joined by line breaks: byte spans, a 64-bit hash of each, and each text's first word.

    first[d]:first[d + 1] are the words of text d; starts and ends are byte
    places in `data`; base[d] is where text d starts there.
    """

    def __init__(self, texts: list[bytes], alphabet: np.ndarray = ALNUM, lower: bool = True):
        self.data = b"\n".join(texts)
        raw = np.zeros(len(self.data) + 8, np.uint8)
        raw[: len(self.data)] = np.frombuffer(self.data, np.uint8)
        self.raw = LOWER[raw] if lower else raw
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = alphabet[self.raw[: len(self.data)]]
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.base[1:])
        self.first = np.searchsorted(self.starts, self.base)

    def hashes(self) -> np.ndarray:
        view = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        length = self.ends - self.starts
        h = mix(length.astype(np.uint64) + _M1)
        if not len(h):
            return h
        left = np.flatnonzero(length <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = left[length[left] > k]
            if not len(left):
                break
            part = view[self.starts[left] + k] & _MASK[np.minimum(length[left] - k, 8)]
            h[left] = mix(h[left] ^ part)
        for i in np.flatnonzero(length > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.raw[self.starts[i] : self.ends[i]].tobytes(), 1)
        return h
