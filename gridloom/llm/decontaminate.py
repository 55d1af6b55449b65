"""Benchmark decontamination by an FM-index per training shard.

A shard is a block of whole documents. Its words, as numbers in the
vocabulary of the test phrases, form the sequence that the index is built
over: a word that no phrase has, and the border between documents, is a
separator, and neighbouring separators are one. Every window of `window`
words of an item (an item of fewer words is one window) is searched backwards
through the wavelet ranks, all windows at a time; occurrences are located from
the sampled suffix places and merged into removal spans.

Benchmark items go to the tasks in parts of about `part_bytes` bytes of text,
as arrays of some ten times that size, made once. Each part has a pass of its
own over the shards, in tasks that hold no other part's arrays; the spans of
all passes are merged, so the benchmark may be of any size.

Nulls: a null text has no words; an item without words, or with a null text,
has no window. A null item_id is left out of the items, but its windows count.
Every input row gives one row, repeated rows too. An empty benchmark hits
nothing. Only the named columns are read, all others are handed on if asked.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, row_blocks, stash
from .fm_index import FMIndex

#: Bytes of text of a shard, which has an index of its own; a longer document is a shard.
SHARD_BYTES = 4 << 20
SPANS = "array<struct<first:long,last:long,from_byte:long,to_byte:long>>"


class Phrases:
    """Distinct windows of items as rows of symbols, and the items that have each, all in arrays.

    items[first[k]:first[k + 1]] are the known ids of the items with window k.
    """

    def __init__(self, rows: list, window: int):
        words = Words([(r[1] or "").encode() for r in rows])
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        count = np.diff(words.first)
        owner = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(symbols))
        whole = np.flatnonzero(at + window <= words.first[1:][owner]) if len(symbols) else at
        patterns = np.stack([symbols[whole + k] for k in range(window)], axis=1) if len(whole) else np.zeros((0, window), np.int32)
        short = np.flatnonzero((count > 0) & (count < window))
        padded = np.zeros((len(short), window), np.int32)
        for i, item in enumerate(short.tolist()):
            padded[i, window - count[item] :] = symbols[words.first[item] : words.first[item + 1]]
        patterns, owner = np.concatenate([patterns, padded]), np.concatenate([owner[whole], short])
        rows_as_one = np.ascontiguousarray(patterns).view(np.dtype((np.void, 4 * window)))[:, 0]
        _, first, which = np.unique(rows_as_one, return_index=True, return_inverse=True)
        self.patterns = patterns[first]
        self.lengths = (self.patterns > 0).sum(1)
        ids = np.array([r[0] if r[0] is not None else 0 for r in rows], np.int64)
        named = np.array([r[0] is not None for r in rows], bool)
        kept = named[owner]
        pairs = np.unique(np.stack([which[kept], ids[owner[kept]]], axis=1), axis=0) if kept.any() else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))


def _hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, dict[int, set]]:
    """For each word whether an occurrence covers it, and the windows that occur in each text."""
    total, texts = len(words.starts), len(words.first) - 1
    covered = np.zeros(total + 1, np.int64)
    if not total or not len(phrases.patterns):
        return covered[:total] > 0, {}
    hashes = words.hashes()
    at = np.searchsorted(phrases.vocabulary, hashes)
    known = phrases.vocabulary[np.minimum(at, len(phrases.vocabulary) - 1)] == hashes
    text_of = np.repeat(np.arange(texts), np.diff(words.first))
    new_text = np.zeros(total, bool)
    new_text[words.first[:-1][np.diff(words.first) > 0]] = True
    previous = np.zeros(total, bool)
    previous[1:] = known[:-1]
    gap = known & (~previous | new_text)
    place = np.cumsum(known) - 1 + np.cumsum(gap)
    sequence = np.zeros(int(place[known][-1]) + 1 if known.any() else 0, np.int64)
    sequence[place[known]] = at[known] + 1
    if not len(sequence):
        return covered[:total] > 0, {}
    word_at = np.zeros(len(sequence), np.int64)
    word_at[place[known]] = np.flatnonzero(known)
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    counts = hi[found] - lo[found]
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    which = np.repeat(found, counts)
    first = word_at[index.locate(rows)]
    np.add.at(covered, first, 1)
    np.add.at(covered, first + phrases.lengths[which], -1)
    pairs = np.unique(text_of[first] * len(phrases.patterns) + which)
    by_text: dict[int, set] = {}
    for p in pairs.tolist():
        k = p % len(phrases.patterns)
        by_text.setdefault(p // len(phrases.patterns), set()).update(phrases.items[phrases.first[k] : phrases.first[k + 1]].tolist())
    return np.cumsum(covered)[:total] > 0, by_text


def _pass(docs: DataFrame, rows: list, window: int, text_col: str, hit_only: bool = False) -> DataFrame:
    """docs with n_words, spans and items filled in by the items of one part; without texts and rows hit nowhere if hit_only."""
    shipped = docs.sparkSession.sparkContext.broadcast(Phrases(rows, window))
    names = docs.columns
    shape = docs.drop(text_col).schema if hit_only else docs.schema
    given = shape.names

    def work(batches):
        phrases = shipped.value
        for part, texts in row_blocks(batches, text_col, SHARD_BYTES):
            words = Words(texts)
            hit, items = _hits(words, phrases)
            borders = np.zeros(len(hit) + 1, bool)
            borders[words.first] = True
            edge = np.zeros(len(hit) + 2, bool)
            edge[1:-1] = hit
            opens = np.flatnonzero(hit & (~edge[:-2] | borders[:-1]))
            closes = np.flatnonzero(hit & (~edge[2:] | borders[1:])) + 1
            own = np.searchsorted(opens, words.first)
            spans, found = [], []
            for i in range(len(texts)):
                w0, b0 = int(words.first[i]), int(words.base[i])
                spans.append([{"first": a - w0, "last": b - w0, "from_byte": int(words.starts[a]) - b0, "to_byte": int(words.ends[b - 1]) - b0} for a, b in zip(opens[own[i] : own[i + 1]].tolist(), closes[own[i] : own[i + 1]].tolist())])
                found.append(sorted(items.get(i, ())))
            columns = dict(zip(names, part.columns)) | {"n_words": pa.array(np.diff(words.first), pa.int64()), "spans": pa.array(spans, part.schema.field("spans").type), "items": pa.array(found, pa.list_(pa.int64()))}
            wanted = pa.RecordBatch.from_arrays([columns[n] for n in given], given)
            yield wanted.take(pa.array(np.flatnonzero([len(x) > 0 for x in spans]))) if hit_only else wanted

    return docs.mapInArrow(work, shape)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (words [first, last) and bytes of merged hits) and items of each row."""
    return _searched(docs, benchmark, window, part_bytes, text_col, (id_col,)).select(F.col(f"kept_{id_col}").alias("doc_id"), "n_words", "spans", "items")


def _merged(hits: DataFrame) -> DataFrame:
    """Per row: its spans of all parts in order, those that overlap or touch as one, and its items."""
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)).cast("int")
    spans = hits.select("row", F.inline("spans")).withColumn("opens", opens).withColumn("island", F.sum("opens").over(so_far))
    whole = spans.groupBy("row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("from_byte").alias("from_byte"), F.max("to_byte").alias("to_byte"))
    lists = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last", "from_byte", "to_byte"))).alias("spans"))
    return lists.join(hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "row")


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, the text, n_words, spans and items of each row.

    A benchmark beyond part_bytes is searched for part by part: the texts are
    written once with a row number, each part has tasks of its own that give
    its hits alone, and the hits of a row meet by its number. So a task runs
    one worker with one part's phrases, however many parts there are.
    """
    spark = docs.sparkSession
    phrases = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = phrases.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    nothing = (F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<long>").alias("items"))
    # each column under a name of its own, so extra columns can't clash
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in keep], F.col(text_col).alias("whole_text"))
    if parts == 1:
        return _pass(rows.select("*", *nothing), [tuple(r) for r in phrases.collect()], window, "whole_text")
    counted = _pass(rows.select("*", *nothing), [], window, "whole_text").drop("spans", "items")
    written = stash(counted.withColumn("row", F.monotonically_increasing_id()), "texts")
    texts = written.select("row", "whole_text", *nothing)
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = [_pass(texts, [tuple(r) for r in phrases.where(part_of == k).collect()], window, "whole_text", True) for k in range(parts)]
    hits = stash(reduce(DataFrame.unionAll, found).drop("n_words"), "hits")
    kept = [f"kept_{c}" for c in keep]
    return written.join(_merged(hits), "row", "left").select(*kept, "whole_text", "n_words", *[F.coalesce(c, n).alias(c) for c, n in zip(("spans", "items"), nothing[1:])])


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = 8 << 20, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the merged removal spans cut out of the texts, and characters counted anew; a text that is hit nowhere stays as it is."""
    names, kinds = docs.columns, [f.dataType for f in docs.schema.fields]
    own = [f"c{i}" for i in range(len(names))]
    text, counted = own[names.index(text_col)], own[names.index(count_col)] if count_col else None
    found = _searched(docs.toDF(*own), benchmark, window, part_bytes, text, tuple(c for c in own if c != text))
    raw = F.col("whole_text").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["to_byte"]))
    starts = F.concat(F.transform("spans", lambda s: s["from_byte"]), F.array(F.octet_length("whole_text").cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("b"), ends.alias("a")), lambda s: F.call_function("substring", raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    cut = F.when(F.size("spans") > 0, F.array_join(F.transform(kept, lambda b: b.cast("string")), "")).otherwise(F.col("whole_text"))
    count = lambda c, kind: F.when(F.size("spans") > 0, F.length(cut).cast(kind)).otherwise(F.col(f"kept_{c}"))
    return found.select(*[cut.alias(c) if c == text else count(c, k).alias(c) if c == counted else F.col(f"kept_{c}").alias(c) for c, k in zip(own, kinds)]).toDF(*names)
