"""Packing by deficit round-robin over source queues.

Every source is a queue of tokens. A round adds a quantum to each queue's
deficit counter and sends as many whole items as the counter allows; what is
left over is carried to the next round, over sequence and partition borders
alike. Quanta are the target proportions of a window of tokens. A queue whose
quantum fills a sequence sends single tokens, so each window holds its target
to within a token. A smaller one would send shreds of documents that way, so
its item is a sequence's length of tokens: it waits until its deficit covers
one, and any run of windows holds its target to within one. Such queues start
with deficits spread over an item, so that they don't all send in one round.
A queue that runs dry leaves the rounds, the others keep their ratio.

After r rounds queue s has sent min(total[s], floor((start[s] + r *
quantum[s]) / item[s]) * item[s]) tokens. With the totals of the queues, and
the place of a document in its queue, the place of each of its tokens in the
packed stream is arithmetic: no loop over windows, no task that sees all of a
source. The stream is cut every `sequence_length` tokens, so only the very
last sequence needs padding.

Nulls: a null text is empty, a null source a queue of its own. An empty text
is its end token alone. Rows with equal ids are packed once each. An empty
table gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_blocks, stash

FIXED_BITS = 16
#: Steps of this share of an item lie far apart from one another, however many are taken.
GOLDEN = (5**0.5 - 1) / 2
PIECE_ROWS = 20_000
#: Characters of white space in a row that the faster encoder is not given: its pattern remembers each of a run's, a million at most.
LONG_RUN = 100_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids as a numpy array, equal to the tokenizer's own.

    The vocabulary of the file drives a faster byte-pair encoder; texts with
    a special token or a very long run of white space in them go to the
    tokenizer itself.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    full = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # few texts need it
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model.get("added_tokens", [])]
    plain = {chr(i) for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spare = iter(range(256, 512))
    byte_of = {chr(i) if chr(i) in plain else chr(next(spare)): i for i in range(256)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    long_run = re.compile(rf"\s{{{LONG_RUN}}}")
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or len(text) >= LONG_RUN and long_run.search(text):
            return np.array(full().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, queue, n_ids, ids (little-endian, unsigned), shard, and `at`, the ids before it in its shard and queue."""
    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), queue.alias("queue"))

    def encode(batches):
        encode_one, shard, at = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        for part, texts in row_blocks(batches, "text", 1 << 21):
            queues, ids, counts, starts = part.column(2).to_pylist(), [], [], []
            for text, q in zip(texts, queues):
                found = np.append(encode_one(text.decode()), np.uint32(end_id))
                starts.append(at.get(q, 0))
                counts.append(len(found))
                at[q] = starts[-1] + len(found)
                narrow = found.astype("<u2")
                ids.append(narrow.tobytes() if (narrow == found).all() else b"\0" + found.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array([shard] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "queue", "n_ids", "ids", "shard", "at"],
            )

    return rows.mapInArrow(encode, "doc_id long, queue string, n_ids long, ids binary, shard int, at long")


def decode_ids(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2") if len(stored) % 2 == 0 else np.frombuffer(stored, "<u4", offset=1)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    sequence_length: int = 2048,
    window_sequences: int = 32,
    targets: dict[str | None, float] | None = None,
    end_id: int = 1,
    max_queues: int = 4096,
    **columns: str,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, queue.

    targets: proportion by source; by default the sources' own shares, with
    which all queues run dry together. Sources it doesn't name share the rest
    by their totals. Beyond max_queues sources, those that targets doesn't
    name share queues by a hash, so the vector of totals that each task holds
    stays bounded.
    """
    coded = stash(tokenized(docs, tokenizer_path, end_id, **columns), "ids")
    by_shard = stash(coded.groupBy("shard", "queue").agg(F.sum("n_ids").alias("n")), "shards")
    sources = by_shard.groupBy("queue").agg(F.sum("n").alias("n"))
    wanted = {"" if k is None else f"={k}": v for k, v in (targets or {}).items()}
    lane = F.col("queue")
    if sources.count() > max_queues:
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(max_queues)).cast("string"))
        lane = F.when(lane.isin(list(wanted)), lane).otherwise(shared) if wanted else shared
    totals = dict(by_shard.groupBy(lane.alias("lane")).agg(F.sum("n")).collect())
    lanes = sorted(totals)
    n = np.array([totals[x] for x in lanes], dtype=np.int64)
    share = n / max(1, n.sum())
    if wanted:
        named = np.array([x in wanted for x in lanes], dtype=bool)
        left = max(0.0, 1 - sum(wanted.values())) * share / max(share[~named].sum(), 1e-12)
        share = np.where(named, [wanted.get(x, 0) for x in lanes], left)
    quantum = np.maximum(1, np.round(share * window_sequences * sequence_length * (1 << FIXED_BITS))).astype(np.int64)
    item = np.where(quantum >> FIXED_BITS >= sequence_length, 1, sequence_length)
    start = np.floor(np.arange(len(lanes)) * GOLDEN % 1 * (item - 1) * (1 << FIXED_BITS)).astype(np.int64)
    before = Window.partitionBy("lane").orderBy("shard", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_shard.withColumn("lane", lane).select("shard", "queue", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = coded.join(bases, ["shard", "queue"]).select("doc_id", "ids", "n_ids", "lane", (F.col("base") + F.col("at")).alias("place"))
    place_of, n_list, quantum_list, item_list, start_list = {x: i for i, x in enumerate(lanes)}, n.tolist(), quantum.tolist(), item.tolist(), start.tolist()

    def sent(r: int) -> np.ndarray:
        """Tokens of each queue after r rounds; past int64, by Python's integers."""
        if r < (1 << 62) // max(quantum_list):
            return np.minimum(n, ((start + r * quantum) >> FIXED_BITS) // item * item)
        return np.array([min(a, ((s + r * q) >> FIXED_BITS) // u * u) for a, q, u, s in zip(n_list, quantum_list, item_list, start_list)], dtype=np.int64)

    def round_of(j: int, k: int) -> int:
        """The round in which queue k sends its token j: the first whose counter covers the token's item."""
        due = (j // item_list[k] + 1) * item_list[k] << FIXED_BITS
        return -(-(due - start_list[k]) // quantum_list[k]) - 1

    def cut(batches):
        sent_by = lru_cache(maxsize=64)(sent)
        for batch in batches:
            rows = []
            for doc, stored, count, x, place in zip(*(c.to_pylist() for c in batch.columns)):
                ids, k, j, last = decode_ids(stored).astype("<u4"), place_of[x], place, place + count
                while j < last:
                    r = round_of(j, k)
                    now, then = sent_by(r), sent_by(r + 1)
                    at = int(now.sum() + (then[:k] - now[:k]).sum() + j - now[k])
                    length = min(last, int(then[k]), j + sequence_length - at % sequence_length) - j
                    rows.append((doc, j - place, length, ids[j - place : j - place + length].tobytes(), count, at // sequence_length, at % sequence_length, x))
                    j += length
                if len(rows) >= PIECE_ROWS:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows):
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "queue"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
