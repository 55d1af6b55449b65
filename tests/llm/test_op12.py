import math

import duckdb
import numpy as np

from gridloom.llm import multi_index, vector_sql

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, cosine=0.9):
    x = multi_index.unit(np.asarray(vectors, np.float32).astype(np.float64))
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], 1 << 60).min(1))
        if (new == root).all():
            return {i: (n, r, i == r) for i, n, r in zip(ids, linked.sum(1).tolist(), root.tolist())}
        root = new


def found(df, **more):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(df, **more).collect()}


def like(base, cosine, rng):
    """A vector at this cosine to the base."""
    way = rng.standard_normal(len(base))
    way -= way @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * way / np.linalg.norm(way)


def frame(spark, vectors, parts=6):
    return spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in enumerate(vectors)], SHAPE).repartition(parts)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, multi_index.near_duplicates(df).collect())) == sorted(con.execute(vector_sql.NEAR_SQL).fetchall())


def test_pairs_at_the_threshold(spark):
    """Partners just over 0.9, the furthest ones; at least 0.9 of all links are met and none is made up."""
    rng = np.random.default_rng(3)
    bases = multi_index.unit(rng.standard_normal((2000, 64)))
    vectors = [*bases, *(like(b, 0.9 + 0.02 * rng.random(), rng) for b in bases[:700])]
    want, got = brute(range(len(vectors)), vectors), found(frame(spark, vectors))
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    everything = found(frame(spark, vectors), recall=1.0)
    assert sum(v[0] for v in everything.values()) >= sum(v[0] for v in got.values())


def test_large_groups_are_counted_whole(spark):
    """Balls, vectors that link to all, some or none of a ball, copies; many blocks."""
    rng = np.random.default_rng(4)
    a, b = multi_index.unit(rng.standard_normal((2, 64)))
    near_a = like(a, math.cos(0.55), rng)  # its group and a's overlap in part
    vectors = [like(a, math.cos(0.05 + 0.15 * rng.random()), rng) for _ in range(600)]
    vectors += [like(b, 0.999, rng) for _ in range(300)] + [b] * 200 + [like(near_a, 0.99, rng) for _ in range(100)]
    vectors += [like(a, math.cos(t), rng) for t in np.linspace(0.2, 0.8, 60)]
    vectors += list(rng.standard_normal((800, 64)))
    order = rng.permutation(len(vectors))
    vectors = [vectors[i] for i in order]
    want = brute(range(len(vectors)), vectors)
    assert found(frame(spark, vectors)) == want


def test_crowded_cells_in_blocks(spark, monkeypatch):
    """A dense group that is too wide for balls, with blocks so small that each cell has many."""
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "VISITORS", 32)
    monkeypatch.setattr(multi_index, "LEAST_BALL", 1 << 40)
    rng = np.random.default_rng(6)
    a = multi_index.unit(rng.standard_normal((1, 64)))[0]
    vectors = [like(a, 0.95, rng) for _ in range(400)] + [a * 3] * 50 + list(rng.standard_normal((200, 64)))
    want, got = brute(range(len(vectors)), vectors), found(frame(spark, vectors), recall=1.0)
    assert got == want


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(7)
    x = multi_index.unit(rng.standard_normal((3000, 20)))
    grid = multi_index.Grid(20, x, 1e5, 0.9, 0.99, 0)
    some = x[:50]
    du, dv = grid._distances(some)
    sums = (du[:, :, None] + dv[:, None, :]).reshape(50, -1)
    nearest = np.argsort(sums, 1)[:, : grid.visits]
    rows, cells = grid.visited(some, np.full(50, -1))
    for i in range(50):
        assert sorted(cells[rows == i] - grid.cell0) == sorted(nearest[i])
    assert (grid.home(some) - grid.cell0 == sums.argmin(1)).all()


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [1.0, 0.0]), (2, [5.0, 0.1]), (None, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, -1.0]), (4, [1.0]), (5, [3.0]), (6, [-1.0]), (7, [1.0, 0.0, 0.0])]
    rows += [(10, None), (11, []), (12, [0.0, 0.0]), (13, [1.0, None]), (14, [nan, 1.0]), (15, [inf, 0.0]), (8, [1e30, 1e30]), (9, [1e-30, 1e-30]), (9, [1e-30, 1e-30]), (16, [-0.0, 2.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SHAPE).selectExpr("vec_id", "embedding", "label as n_links", "label as kept", "label as x", "label as id", "label as h1")
    got = sorted((tuple(r) for r in multi_index.near_duplicates(df).collect()), key=repr)
    alone = {7, 6, 10, 11, 12, 13, 14, 15}
    want = [(i, 0, i, True) for i in alone] + [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 1, 3, True), (16, 1, 3, False), (None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False)]
    want += [(8, 2, 8, True), (9, 2, 8, False), (9, 2, 8, False)]
    assert got == sorted(want, key=repr)
    assert multi_index.near_duplicates(df.where("false")).collect() == []
    assert multi_index.near_duplicates(df.where("vec_id = 10")).collect() == [(10, 0, 10, True)]
