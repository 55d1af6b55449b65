"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link at `max_bits` (1 or 2) or fewer differing
bits. Cut in two halves, one half of a linked pair differs by at most one
bit. So each distinct fingerprint is indexed under its 64 one-wildcard
variants (half, deleted bit, the other 31 bits); linked pairs meet under an
equal variant and are verified on all 64 bits. Of very many fingerprints too
many would meet under 38 bits by chance; from WIDE_FROM on, variants are 54 bits
wide and there are 128: a whole half and a quarter of the other without one
bit, or a half without one bit and a whole quarter of the other. At two
differing bits one of them is equal, too.

Documents are first reduced to distinct fingerprints, so exact copies, however
many, are one entry. A variant of two fingerprints gives its pair from an
aggregate; one of a few is joined with itself; one of more than `crowd` would
give pairs by the square, so the fingerprints in crowded variants are indexed
once more under variants with max_bits deleted bits, which at most 2^max_bits
fingerprints share and which need no verification. All three ways together
lose no link.

Nulls: a null text has no words. No words: fingerprint zero, linked like any
other. Null ids are kept; a component of null ids alone has a null id. Rows
with equal ids each appear. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_blocks, stash
from .components import components

SEED = 42
SHINGLE_BLOCK = 100_000
#: Keys that a broadcast may hold: 16 bytes each.
BROADCAST_KEYS = 1_000_000
HEAVY = 2000
#: Distinct fingerprints from which on variants are wide.
WIDE_FROM = 1 << 26


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Signed 64-bit SimHash of a text's shingles, taken in blocks so a long text needs no more memory."""
    words = text.lower().split()
    if not words:
        return 0
    k, total = words_per_shingle, max(1, len(words) - words_per_shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, SHINGLE_BLOCK):
        block = words[at : min(at + SHINGLE_BLOCK, total) + k - 1]
        shingles = map(b" ".join, zip(*(block[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row."""

    def work(batches):
        for part, texts in row_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, words_per_shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def _near(a: str, b: str, max_bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _one_wildcard(fps: DataFrame) -> DataFrame:
    """(key, fp): key holds half, deleted bit and the half without it, 38 bits in all."""
    keys = []
    for half in (0, 1):
        part = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit((1 << 32) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << bit))) + F.lit((half * 32 + bit) << 32) for bit in range(32)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _wide_wildcard(fps: DataFrame) -> DataFrame:
    """(key, fp): key holds which variant it is, and 47 or 48 bits of the fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("fp", 32)
    quarter = lambda half, q: F.shiftright(half, 16 * q).bitwiseAND(F.lit(0xFFFF))
    joined = lambda kind, half, rest: F.lit(kind << 48) + F.shiftleft(half, 16) + rest
    keys = []
    for h, (whole, other) in enumerate(((low, high), (high, low))):
        for q in (0, 1):
            keys += [joined((2 * h + q) * 16 + bit, whole, quarter(other, q).bitwiseAND(F.lit(0xFFFF ^ (1 << bit)))) for bit in range(16)]
    for bit in range(32):
        keys += [joined(64 + 2 * bit + q, high.bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << bit))), quarter(low, q)) for q in (0, 1)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _crowded_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links to the smallest of the at most 2^max_bits fingerprints that agree outside max_bits deleted bits."""
    wild = fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(sum(1 << b for b in c))) for c in combinations(range(64), max_bits)])))
    wild = wild.select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    met = wild.groupBy("mask", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b").distinct()


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 256, wide: bool | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fps at max_bits or fewer differing bits.

    wide: which variants; by default by the number of fps.
    """
    if max_bits not in (1, 2):
        raise ValueError("the variants of crowded fingerprints are few enough for 1 or 2 deleted bits only")
    # 64 rows or more come from each: dealt out first, as few bytes of them make few partitions
    variants = _wide_wildcard if (fps.count() >= WIDE_FROM if wide is None else wide) else _one_wildcard
    keyed = variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    buckets = stash(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    found = buckets.where("n = 2").where(_near("a", "b", max_bits)).select("a", "b")
    sizes = {r["kind"]: r["count"] for r in buckets.groupBy(F.when(F.col("n") > crowd, "crowd").when(F.col("n") > 2, "few").otherwise("two").alias("kind")).count().collect()}
    # the keys of shared variants go to the variants while they are few; beyond that both are shuffled
    sized = F.broadcast if sizes.get("few", 0) + sizes.get("crowd", 0) <= BROADCAST_KEYS else lambda df: df
    if sizes.get("few"):
        few = keyed.join(sized(buckets.where(f"n > 2 and n <= {crowd}").select("key")), "key")
        left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
        found = found.union(left.join(right, "key").where("a < b").where(_near("a", "b", max_bits)).select("a", "b"))
    if sizes.get("crowd"):
        crowded = keyed.join(sized(buckets.where(f"n > {crowd}").select("key")), "key").select("fp").distinct()
        found = found.union(_crowded_links(stash(crowded, "crowded"), max_bits))
    return found


def _components(prints: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """prints, a written table with doc_id and fp, with the component_id of each row.

    A fingerprint that more than one row in HEAVY has, of which there are
    under HEAVY, meets its rows by broadcast, the others by shuffle, so no
    task gets all copies of a text.
    """
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    roots = stash(components(links(classes.select("fp"), max_bits, crowd)), "roots")
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    final = classes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "first").alias("component_id"))
    final = stash(final, "components")
    heavy = F.col("copies") * HEAVY > prints.count()
    hot = F.broadcast(final.where(heavy).drop("copies"))
    rest = prints.join(F.broadcast(final.where(heavy).select("fp")), "fp", "left_anti").join(final.where(~heavy).drop("copies"), "fp")
    return prints.join(hot, "fp").unionByName(rest)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, crowd: int = 256, **columns: str) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id its links reach)."""
    prints = stash(fingerprints(docs, words_per_shingle, **columns), "fingerprints")
    return _components(prints, max_bits, crowd).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
