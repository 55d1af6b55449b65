"""Centroid clustering in exact integers, screened in float32.

Vectors of exactly `size` finite components become integers floor(64 * x). A
block of them meets all centroids in one float32 matrix product. Of a product
of n terms, whatever the order of its additions, the error is at most
gamma(n + 2) * |x| * |c|, with gamma(k) = k u / (1 - k u) and u = 2^-24 (two
more for rounding x and c); so each score has an interval that holds the exact
one. Where one interval lies under all others the centroid is decided; where
intervals overlap, the distances of the centroids they belong to are worked
out again in exact integers, and of equal ones the lowest number wins.

Sums are exact, too: each task adds up its rows, in limbs of 32 bits where
components reach LARGE, and Spark adds the tasks' rows as decimals, so the driver meets
one row per centroid, limb and component. A round is one pass over the table,
without a shuffle of vectors.

Nulls: null vectors, vectors of another length or with null or non-finite
components are left out. A null id starts no centroid but is assigned, with a
null id in its row. Rows with equal ids count each; as starts they are ordered
by their components. Fewer than `k` kept vectors make fewer centroids; none (or an empty
table) give no rows. Distances and inertias beyond a long are the greatest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this size on, components go through Python's integers.
LARGE = 1 << 26
MOST = (1 << 63) - 1
ROWS = 8192
LIMB = 32
_U = 2.0**-24


def kept(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64) -> DataFrame:
    """(id, x) of the vectors that take part, components as doubles."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where((F.size("x") == size) & finite)


def as_integers(x: list[float]) -> list[int]:
    return [int(v) * 64 if abs(v) >= 2.0**53 else math.floor(64 * v) for v in x]


class Centres:
    """Centroids of exact integers and what screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = all(abs(v) < LARGE for row in rows for v in row)
        if self.small:
            self.whole = np.array(rows, np.int64)
            self.single = self.whole.astype(np.float32)
            self.square = (self.whole**2).sum(1).astype(np.float64)
            self.norm = np.sqrt(self.square)

    def screened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a centroid may be the nearest, by row; and how wide the intervals are."""
        k = (x.shape[1] + 3) * _U
        product = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        score = self.square - 2 * product
        reach = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        wide = (2 * k / (1 - k) * (1 + 2.0**-30)) * reach[:, None] * self.norm + 2.0**-50 * (self.square + 2 * np.abs(product))
        return score - wide <= (score + wide).min(1)[:, None], wide

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest centroid of rows of int64, each component under LARGE, and how many rows were recomputed."""
        may = self.screened(x)[0]
        out = may.argmax(1)
        again = np.flatnonzero(may.sum(1) > 1)
        for i in range(0, len(again), 1024):
            rows = again[i : i + 1024]
            exact = ((x[rows][:, None, :] - self.whole[None]) ** 2).sum(2)
            out[rows] = np.where(may[rows], exact, MOST).argmin(1)
        return out, len(again)

    def nearest_large(self, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(self.rows))[::-1]


def _blocks(batches: Iterator[pa.RecordBatch], size: int, centres: Centres):
    """(ids, rows, nearest, distance) of small rows in arrays, and of large ones in lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            with np.errstate(over="ignore"):
                scaled = np.floor(64 * x)
            plain = (np.abs(scaled) < LARGE).all(1) if centres.small else np.zeros(len(x), bool)
            if plain.any():
                whole = scaled[plain].astype(np.int64)
                near = centres.nearest(whole)[0]
                yield part.column(0).filter(pa.array(plain)), whole, near, ((whole - centres.whole[near]) ** 2).sum(1)
            if not plain.all():
                rows = [as_integers(v) for v in x[~plain].tolist()]
                found = [centres.nearest_large(v) for v in rows]
                yield part.column(0).filter(pa.array(~plain)), rows, [f[0] for f in found], [min(f[1], MOST) for f in found]


def _limbs(value: int) -> list[int]:
    """value = sum of limb k times 2^(32 k); the last one has the sign."""
    out = []
    while abs(value) >= 1 << (LIMB - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def means(vectors: DataFrame, centres: Centres, size: int = 64) -> Centres:
    """The centroids after one round: floors of exact means; empty ones stay."""
    k = len(centres.rows)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # place `size` of limb 0 is the count
        sums: dict[int, np.ndarray] = {0: np.zeros((k, size + 1), np.int64)}
        for _, rows, near, _ in _blocks(batches, size, centres):
            if isinstance(rows, np.ndarray):
                mine = np.zeros((k, len(rows)))
                mine[near, np.arange(len(rows))] = 1
                sums[0][:, :size] += (mine @ rows.astype(np.float64)).astype(np.int64)  # under 2^53: exact
                sums[0][:, size] += mine.sum(1).astype(np.int64)
            else:
                for row, c in zip(rows, near):
                    sums[0][c, size] += 1
                    for i, value in enumerate(row):
                        for limb, part in enumerate(_limbs(value)):
                            sums.setdefault(limb, np.zeros((k, size + 1), np.int64))[c, i] += part
        for limb, table in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([limb] * k, pa.int32()), pa.array(list(table), pa.list_(pa.int64()))], ["cluster", "limb", "total"])

    parts = vectors.mapInArrow(totals, "cluster int, limb int, total array<long>")
    found = parts.select("cluster", "limb", F.posexplode("total").alias("place", "part")).groupBy("cluster", "limb", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    sums = [[0] * (size + 1) for _ in range(k)]
    for row in found.collect():  # k * (size + 1) rows a limb
        sums[row.cluster][row.place] += int(row.total) << (LIMB * row.limb)
    return Centres([[v // s[size] for v in s[:size]] if s[size] else old for s, old in zip(sums, centres.rows)])


def starts(vectors: DataFrame, k: int = 16) -> Centres | None:
    """The k vectors with the smallest hashes of `1:<id>`; None if there is no vector."""
    first = vectors.where(F.col("id").isNotNull()).select("x", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"))
    rows = first.orderBy("h", "x").limit(k).collect()
    return Centres([as_integers(row.x) for row in rows]) if rows else None


def clustered(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3) -> tuple[DataFrame, Centres | None]:
    """(id, cluster, distance) of each kept vector after the last assignment, and the final centroids."""
    vectors = kept(df, id_col, vec_col, size)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    centres = starts(vectors, k)
    if centres is None:
        return df.sparkSession.createDataFrame([], schema), None
    for _ in range(rounds):
        centres = means(vectors, centres, size)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, near, distance in _blocks(batches, size, centres):
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(distance, pa.int64())], [id_col, "cluster", "distance"])

    return vectors.mapInArrow(assigned, schema), centres


def report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """`clustered` with the inertia of each cluster and of all, and a hash of each final centroid."""
    out, centres = clustered(df, id_col, vec_col, size, k, rounds)
    if centres is None:
        return out.selectExpr("*", "cast(null as long) as cluster_inertia", "cast(null as long) as inertia", "cast(null as string) as centroid_sha256")
    each = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = F.array(*[F.lit(min(each.get(c, 0), MOST)) for c in range(len(centres.rows))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for row in centres.rows])
    return out.select("*", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(min(sum(each.values()), MOST)).alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
