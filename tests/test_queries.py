"""Every registered query runs on the smallest tables; those with SQL give its rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5)
        return v.item() if hasattr(v, "item") else v

    names = sorted(frame.columns)
    return sorted(repr(tuple(value(v) for v in row)) for row in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
