"""Scores and rounding equal SQL's to the last bit, where keys are shifted far too."""

import duckdb

from gridloom.plans import registry


def test_scalar_scores_of_far_keys_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    path = f"{tmp_path}/events.parquet"
    con.execute(f"COPY (SELECT i AS event_id, i // 50 + i % 61 * 10000000 AS user_id, CAST(i % 60000 AS DOUBLE) / 100 AS value, 'view' AS event_type FROM range(20000) t(i)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = registry.queries()["scalar_scores"](spark, str(tmp_path)).select("event_id", "nearness", "penalty", "to_box").collect()
    assert {tuple(x) for x in got} == set(con.execute(f"SELECT event_id, nearness, penalty, to_box FROM ({registry.oracle_sql()['scalar_scores']})").fetchall())


def test_rounding_of_large_values_equals_sql(spark):
    values = [x * sign for k in range(2000) for x in (1e7 * (k * 1234567.891) ** 0.5, 4503599627.370497 + k / 3, k / 7) for sign in (1.0, -1.0)] + [float("inf"), 1e305, -1e305, 0.0]
    want = duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    got = registry.rounded(spark.createDataFrame([(x,) for x in values], "x double").coalesce(1), 6).collect()
    assert [x.x for x in got] == [x[0] for x in want]
