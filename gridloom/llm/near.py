"""Near-duplicate documents: SimHash signatures first, then what they leave, without loss.

Two texts link where their sets of word shingles (64-bit hashes of them) are
`similarity` alike by Jaccard, which is worked out on the whole texts of every
candidate pair. Candidates come in three steps:

1. Pairs by the deletion-variant signatures of simhash.links over the
   fingerprints of the shingle sets.
2. A prefix filter. In one order of all shingles, rare ones first, two texts so
   alike have one of the first `size - ceil(similarity * size) + 1` of each in
   common (its keys), and the first one in common stands early enough in both
   for the rest to suffice. All members of a key of few members are paired so;
   of a key of many each is paired with the one in which the key stands first,
   as an original has fewer shingles of its own than its copies.
3. Members of a key that are in different components by then are paired by the
   same test of places, the smaller text's place first, so no link between
   components is lost whatever the size of a group. A pair is made at the first
   key of each run of keys that both have.

Before texts are compared a pair must pass a bound on its overlap by parity
bitmaps, which never undercounts. Which shingles are rare is estimated; that
orders the search and loses no pair.

Distribution: keys are counted with partial sums before they are joined; a
text of very many pairs is dealt out in salted copies to its pairs; no group
is gathered. Pairs of step 3 grow with the square only of groups that share
usual shingles, are between 0.72 and the similarity alike and link to nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import release, scratch
from .common import SOLID, Words, mix, row_blocks, sized_broadcast, stash
from .components import components
from .simhash import SHINGLE_BLOCK, links

#: Pairs of texts that a worker turns into Python objects at a time.
PAIR_ROWS = 100
#: Pairs of one text that one copy of it serves.
PAIRS_A_COPY = 256
#: Shingles among which a worker counts those of several texts; from so many texts on a shingle is often; so many of these order the rest.
COUNT_BLOCK = 2_000_000
OFTEN = 8
MOST_OFTEN = 200_000
#: Bits of a text's parity bitmap.
BITMAP = 2048
MEMBER = ["m0", "m1"]
SLACK = 1e-6


def shingle_sets(texts: list[bytes], words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of texts, in this order; a text of fewer words is one shingle, one of none has none."""
    words, k = Words(texts, SOLID), words_per_shingle
    h, count = words.hashes(), np.diff(words.first)
    text, n = np.repeat(np.arange(len(texts)), count), len(h)
    grams = mix(h)
    for i in range(1, k):
        after = np.zeros(n, np.uint64)
        after[: max(0, n - i)] = h[i:]
        grams = mix(grams ^ after)
    whole = np.arange(n) + k <= words.first[1:][text] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    single = np.zeros(len(short), np.uint64)
    for j, d in enumerate(short.tolist()):
        for w in h[words.first[d] : words.first[d + 1]]:
            single[j : j + 1] = mix(single[j : j + 1] ^ w)
    text, grams = np.concatenate([text[whole], short]), np.concatenate([grams[whole], single])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return text[new], grams[new]


def fingerprint_of(grams: np.ndarray) -> int:
    """Signed 64-bit SimHash of a text's shingle set, in blocks; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), SHINGLE_BLOCK):
        part = grams[at : at + SHINGLE_BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def bitmap_of(grams: np.ndarray) -> np.ndarray:
    """For each of BITMAP buckets whether an odd number of a text's shingles falls in it, as signed 64-bit words."""
    odd = np.bincount((grams % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _prints(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, m0, m1, w0, w1) per row, w0 and w1 a hash of the words; beside them rows without w0, of shingles in several texts of a block."""
    names = ["doc_id", *MEMBER, "w0", "w1", "often", "times"]

    def often(block):
        found, times = np.unique(np.concatenate(block), return_counts=True)
        found, times = found[times > 1], times[times > 1]
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.array([_longs(found)], pa.list_(pa.int64())), pa.array([times.tolist()], pa.list_(pa.int64()))], names)

    def work(batches):
        block, held = [], 0
        for part, texts in row_blocks(batches, "text"):
            words = [xxhash.xxh3_128_intdigest(b" ".join(t.lower().split())) for t in texts]
            none = pa.nulls(len(texts), pa.list_(pa.int64()))
            halves = [_longs(np.array([w >> by & (1 << 64) - 1 for w in words], np.uint64)) for by in (0, 64)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *halves, none, none], names)
            block.append(shingle_sets(texts, words_per_shingle)[1])
            held += len(block[-1])
            if held > COUNT_BLOCK:
                yield often(block)
                block, held = [], 0
        if block:
            yield often(block)

    return rows.select("doc_id", "text", *MEMBER).mapInArrow(work, "doc_id long, m0 long, m1 long, w0 long, w1 long, often array<long>, times array<long>")


def _prefixes(rows: DataFrame, words_per_shingle: int, similarity: float, often: np.ndarray, times: np.ndarray) -> DataFrame:
    """(doc_id, m0, m1, fp, size, bitmap, keys) per row; keys are the first of a text's shingles in the order of all."""
    names = ["doc_id", *MEMBER, "fp", "size", "bitmap", "keys"]

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int64()))

    def work(batches):
        for part, texts in row_blocks(batches, "text"):
            n = len(texts)
            text, grams = shingle_sets(texts, words_per_shingle)
            size = np.bincount(text, minlength=n)
            load = np.zeros(len(grams), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                load = np.where(often[at] == grams, times[at], 0)
            order = np.lexsort((grams, load, text))
            place = np.arange(len(grams)) - (np.cumsum(size) - size)[text]
            most = np.where(size > 0, size - np.ceil(similarity * size - SLACK).astype(np.int64) + 1, 0)
            keys = grams[order][place < most[text]]
            cut = np.searchsorted(text, np.arange(n + 1))
            own = [grams[i:j] for i, j in zip(cut, cut[1:])]
            maps = np.concatenate([bitmap_of(g) for g in own])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array([fingerprint_of(g) for g in own], pa.int64()), pa.array(size.astype(np.int64)), lists(maps, np.full(n, BITMAP // 64)), lists(keys.view(np.int64), np.minimum(most, size))], names
            )

    return rows.select("doc_id", "text", *MEMBER).mapInArrow(work, "doc_id long, m0 long, m1 long, fp long, size long, bitmap array<long>, keys array<long>")


def _shares(pairs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(a, b, share) of rows (a, text, b, other): Jaccard similarity of the shingle sets."""

    def of(text):
        return shingle_sets([(text or "").encode()], words_per_shingle)[1]

    def work(batches):
        last, kept = None, of("")
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, PAIR_ROWS):
                part = batch.slice(at, PAIR_ROWS)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                text, grams = shingle_sets(texts, words_per_shingle)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                for i, (two, other) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if two != last:  # pairs mostly come sorted by their second text
                        last, kept = two, of(other)
                    one = grams[cut[i] : cut[i + 1]]
                    both = len(np.intersect1d(one, kept, assume_unique=True))
                    found.append(both / (len(one) + len(kept) - both) if len(one) or len(kept) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["a", "b", "share"])

    return pairs.select("a", "text", "b", "other").mapInArrow(work, "a long, b long, share double")


def _needed(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Shingles that two texts of these sizes must share."""
    return F.ceil((size_a + size_b) * (similarity / (1 + similarity)) - SLACK)


def possible(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule out the similarity: shingles in one text alone are no fewer than buckets that differ."""
    one = lambda n: prefixes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("bitmap").alias(f"bitmap_{n}"))
    differ = F.aggregate(F.zip_with("bitmap_a", "bitmap_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    a, b = F.col("size_a"), F.col("size_b")
    return pairs.join(one("a"), "a").join(one("b"), "b").where(a + b - differ >= 2 * _needed(a, b, similarity)).select("a", "b")


def signature_pairs(prefixes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) of the first members of linked fingerprints, and of each other member of a fingerprint and its first."""
    first = stash(prefixes.where("size > 0").groupBy("fp").agg(F.min("node").alias("first")), "prints_once")
    near = links(first.select("fp"), max_bits)
    end = lambda n: first.select(F.col("fp").alias(n), F.col("first").alias(f"first_{n}"))
    met = near.join(end("a"), "a").join(end("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = prefixes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return met.union(same)


def _paired(small: DataFrame, rows: DataFrame, similarity: float, apart: bool) -> DataFrame:
    """(a, b) of members of a key that pass the test of places, at the first of the keys that follow each other in both.

    Rows are (key, node, info, before[, group]); info is place << 32 | size,
    before the last shared key before this. `small` has those that may be the
    smaller text of a pair.
    """
    more = ["group"] if apart else []
    one = lambda df, n: df.select("key", F.col("node").alias(n), F.col("info").alias(f"info_{n}"), F.col("before").alias(f"before_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in more])
    size = lambda n: F.col(f"info_{n}").bitwiseAND(F.lit((1 << 32) - 1))
    left = lambda n: size(n) - F.shiftright(f"info_{n}", 32)
    needed = _needed(size("a"), size("b"), similarity)
    ordered = (size("a") < size("b")) | ((size("a") == size("b")) & (F.col("a") < F.col("b")))
    fresh = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    test = ordered & fresh & (left("a") >= needed) & (left("b") >= needed)
    if apart:
        test = test & (F.col("group_a") != F.col("group_b"))
    return one(small, "a").join(one(rows, "b"), "key").where(test).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_links(prefixes: DataFrame, linked, similarity: float, crowd: int = 8) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs that `linked` confirms.

    prefixes is a written table of _prefixes with `node`, each text once;
    linked gives those of pairs (a, b) that link.
    """
    info = lambda place: F.shiftleft(place.cast("long"), 32).bitwiseOR(F.col("size"))
    keyed = prefixes.select("node", "size", F.posexplode("keys").alias("place", "key")).select("key", "node", info(F.col("place")).alias("info"))
    counts = stash(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key_counts")
    before = F.lag("key").over(Window.partitionBy("node").orderBy("info"))
    rows = stash(keyed.join(counts, "key").withColumn("before", before), "shared_keys")
    release(counts)
    size, place = F.col("info").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("info", 32)
    smaller = lambda df: df.where(size - place >= _needed(size, size, similarity))
    few, crowded = rows.where(F.col("n") <= crowd), rows.where(F.col("n") > crowd)
    hubs = crowded.groupBy("key").agg(F.min(F.struct("info", "node"))["node"].alias("hub"))
    star = crowded.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    tried = _paired(smaller(few), few, similarity, False).union(star).union(signature_pairs(prefixes))
    first = stash(tried.distinct(), "pairs")
    edges = linked(first)
    if crowded.isEmpty():
        return edges
    roots = stash(components(edges), "crowd_roots")
    grouped = stash(crowded.join(roots, "node", "left").select("key", "node", "info", "before", F.coalesce("root", "node").alias("group")), "crowd_groups")
    split = grouped.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("key")
    apart = stash(grouped.join(split, "key", "left_semi"), "crowd_apart")
    rest = stash(_paired(smaller(apart), apart, similarity, True).distinct().join(first, ["a", "b"], "left_anti"), "rest_pairs")
    return edges.union(linked(rest))


def _less(keyed: DataFrame, going: DataFrame, twice: DataFrame) -> DataFrame:
    """keyed without the members of going and with one row of each member of twice."""
    kept = keyed.join(sized_broadcast(going), MEMBER, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(sized_broadcast(twice), MEMBER, "left_semi").dropDuplicates(MEMBER)
    return kept.join(sized_broadcast(twice), MEMBER, "left_anti").unionByName(once)


def _with_texts(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) as (a, text, b, other), the end of more pairs second; an end of many pairs has as many copies as its pairs need."""
    ends = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")), "ends")
    members = stash(ends.join(nodes, "node"), "members")
    of = stash(texts.select("text", *MEMBER).join(sized_broadcast(members), MEMBER).select("node", "copies", "text"), "texts")
    dealt = of.select("node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text")
    hot = sized_broadcast(stash(ends.where("copies > 1"), "hot_ends"))
    end = lambda n: hot.select(F.col("node").alias(n), F.col("copies").alias(f"copies_{n}"))
    sized = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").fillna(1, ["copies_a", "copies_b"])
    turned = F.col("copies_a") > F.col("copies_b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    met = sized.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("copies_a", "copies_b").alias("n"), swap("copies_b", "copies_a").alias("m"))
    met = met.select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("copy_a"), F.pmod(F.xxhash64("a"), F.col("m")).cast("int").alias("copy_b"))
    left = dealt.select(F.col("node").alias("a"), F.col("copy").alias("copy_a"), "text")
    right = dealt.select(F.col("node").alias("b"), F.col("copy").alias("copy_b"), F.col("text").alias("other"))
    return met.join(left, ["a", "copy_a"]).join(right, ["b", "copy_b"])


def deduplicated(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest id; all columns stay, whatever their names.

    Texts of the same words are one class; classes link as the module says, and
    the components of links are the groups. Null texts have no words, and all
    texts without words are one class. Null ids come after others; of rows
    equal in id and text one stays. An empty table gives no rows.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string")
    # two hashes of id and text stand for a row: 128 bits don't meet by chance
    keyed = rows.select("*", F.xxhash64(ident, text).alias("m0"), F.xxhash64(F.lit("other"), text, ident).alias("m1"))
    plain = keyed.select(ident.alias("doc_id"), text.alias("text"), *MEMBER)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *MEMBER)
    with scratch() as keep:
        found = stash(_prints(plain, words_per_shingle), "prints")
        prints = found.where("w0 is not null").select("doc_id", *MEMBER, "w0", "w1")
        counted = found.where("w0 is null").select(F.explode(F.arrays_zip("often", "times")).alias("s")).groupBy("s.often").agg(F.sum("s.times").alias("times"))
        counted = counted.where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "often").limit(MOST_OFTEN).toPandas()
        often, times = counted["often"].to_numpy(np.int64).view(np.uint64), counted["times"].to_numpy(np.int64)
        often, times = often[np.argsort(often)], times[np.argsort(often)]
        classes = stash(prints.groupBy("w0", "w1").agg(F.min(order).alias("first")).select("first.*"), "classes")
        copies = stash(prints.select(*MEMBER).distinct().join(classes.select(*MEMBER), MEMBER, "left_anti"), "copies")
        twice = keep(stash(prints.groupBy(*MEMBER).count().where("count > 1").select(*MEMBER), "twice"))
        texts = _less(plain, copies, twice)
        prefixes = stash(_prefixes(texts, words_per_shingle, similarity, often, times).withColumn("node", F.monotonically_increasing_id()), "prefixes")

        def linked(pairs: DataFrame) -> DataFrame:
            with scratch() as hold:
                open_ = stash(possible(pairs, prefixes, similarity), "possible")
                met = _with_texts(open_, texts, prefixes.select("node", *MEMBER))
                return hold(stash(_shares(met, words_per_shingle).where(F.col("share") >= similarity).select("a", "b"), "links"))

        roots = stash(components(near_links(prefixes, linked, similarity)), "roots")
        joined = stash(prefixes.select("node", "doc_id", *MEMBER).join(roots, "node"), "grouped")
        heads = joined.groupBy("root").agg(F.min(order).alias("head")).select("head.m0", "head.m1")
        going = keep(stash(joined.select(*MEMBER).join(heads, MEMBER, "left_anti").union(copies).distinct(), "going"))
    return _less(keyed, going, twice).select(*rows.columns).toDF(*names)
