import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gridloom.llm import centroids, vector_sql

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, size, k=16, rounds=3):
    """Plain Python integers, one vector at a time."""
    kept = [(i, x) for i, x, *_ in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    kept = [(i, [math.floor(Fraction(v) * 64) for v in x]) for i, x in kept]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centres = [x for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    most = (1 << 63) - 1
    ends = [near(x) for _, x in kept]
    each = [min(sum(min(d, most) for d, a in ends if a == j), most) for j in range(len(centres))]
    total = min(sum(min(d, most) for d, _ in ends), most)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, min(d, most), each[a], total, sha[a]) for (i, _), (d, a) in zip(kept, ends)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = centroids.report(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want = con.execute(vector_sql.clustering_sql())
    assert got.columns == [c[0] for c in want.description]
    assert rows_of(got) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("top", [1.0, 1e5, 1e9, 1e30])
def test_brute_force(spark, top):
    """Grid points give many ties; large components go through Python's integers and limbs."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) * top / 2 for v in rng.integers(-2, 3, 4)], 0) for i in range(150)]
    rows += [(1000 + i, [float(v) * 0.01 for v in rng.integers(-2, 3, 4)], 0) for i in range(50)]
    got = centroids.report(spark.createDataFrame(rows, SHAPE).repartition(5), size=4, k=7)
    assert rows_of(got) == brute(rows, 4, 7)


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    ok = [[0.5, 1.0], [0.5, 1.0], [-3.0, 0.0], [0.0, -0.0]]
    odd = [None, [], [1.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, x, 1) for i, x in enumerate(ok)] + [(50 + i, x, 1) for i, x in enumerate(odd)] + [(None, [9.0, 9.0], 1), (2, [7.0, 7.0], 1)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("vec_id", "embedding", "label as cluster", "label as x", "label as id", "label as distance")
    assert rows_of(centroids.report(df, size=2, k=3)) == brute(rows, 2, 3)
    assert rows_of(centroids.report(df, size=2)) == brute(rows, 2)  # fewer vectors than centroids
    none = centroids.report(df.where("false"), size=2)
    assert none.collect() == [] and none.columns == centroids.report(df, size=2).columns
    assert centroids.report(df.where("vec_id >= 50"), size=2).collect() == []


def test_intervals_hold_the_exact_scores():
    """No matter how the float32 product rounds, the exact score lies within its interval, and few rows are recomputed."""
    rng = np.random.default_rng(1)
    for top in (10, 10_000, (1 << 26) - 1):
        x = rng.integers(-top, top + 1, (400, 64))
        centres = centroids.Centres(rng.integers(-top, top + 1, (16, 64)).tolist())
        _, wide = centres.screened(x)
        product = (x.astype(np.float32) @ centres.single.T).astype(np.float64)
        exact = x.astype(object) @ centres.whole.T.astype(object)
        assert (np.abs(2 * (product - exact.astype(float))) <= wide).all()
        near, again = centres.nearest(x)
        distance = ((x[:, None, :].astype(object) - centres.whole[None].astype(object)) ** 2).sum(2)
        assert near.tolist() == [min(range(16), key=lambda k: (row[k], k)) for row in distance]
        assert again < 40


def test_ties_take_the_lowest_number():
    centres = centroids.Centres([[5, 5], [1, 0], [-1, 0], [1, 0]])
    near, again = centres.nearest(np.array([[0, 0], [1, 0], [0, 9], [5, 5]]))
    assert near.tolist() == [1, 1, 0, 0] and again == 2
