"""All queries of the grid and region operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "snapshot_metrics"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the views derived from them that queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def e(self) -> DataFrame:
        """Events as cells: frame, step, r, c, z, occ."""
        return self.events.selectExpr("*", "event_id div 1000 as frame", "event_id div 500 as step", "user_id % 40 as r", "(event_id * 7919) % 64 as c", "event_id % 8 as z", "event_type in ('error', 'purchase') as occ")

    @property
    def occupied(self) -> DataFrame:
        return self.e.where("occ").select("frame", "r", "c").distinct()

    @property
    def cells(self) -> DataFrame:
        return self.e.select("frame", "r", "c").distinct()

    @property
    def gt(self) -> DataFrame:
        """Embeddings as a raster 25 wide with two label maps."""
        return self.embeddings.selectExpr("vec_id div 250 as scene", "vec_id div 25 as r", "vec_id % 25 as c", "label + 1 as label")

    @property
    def pred(self) -> DataFrame:
        return self.embeddings.selectExpr("vec_id div 250 as scene", "vec_id div 25 as r", "vec_id % 25 as c", "cast(vec_id * 31 % 10 + if(vec_id % 3 = 0, 0, 1) as int) as label").where("label > 0")

    @property
    def lines(self) -> DataFrame:
        """Order lines as runs of cells on grid lines."""
        return self.lineitem.selectExpr("l_suppkey % 5 as frame", "l_orderkey % 97 as r", "l_partkey % 211 as c").distinct()


#: The same views in SQL.
VIEWS = """
e AS (SELECT *, event_id // 1000 AS frame, event_id // 500 AS step, user_id % 40 AS r, (event_id * 7919) % 64 AS c, event_id % 8 AS z, event_type IN ('error', 'purchase') AS occ FROM events),
occupied AS (SELECT DISTINCT frame, r, c FROM e WHERE occ),
cells AS (SELECT DISTINCT frame, r, c FROM e),
gt AS (SELECT vec_id // 250 AS scene, vec_id // 25 AS r, vec_id % 25 AS c, CAST(label + 1 AS BIGINT) AS label FROM embeddings),
pred AS (SELECT * FROM (SELECT vec_id // 250 AS scene, vec_id // 25 AS r, vec_id % 25 AS c, vec_id * 31 % 10 + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS label FROM embeddings) WHERE label > 0),
lines AS (SELECT DISTINCT l_suppkey % 5 AS frame, l_orderkey % 97 AS r, l_partkey % 211 AS c FROM lineitem)
"""


def _round(c: str, places: int) -> Column:
    """Half away from zero after scaling, as the SQL's engine does it; Spark's own round takes the shortest decimal instead, which may lie just under a half."""
    x = F.col(c).cast("double")
    scaled = F.abs(x) * float(10**places)
    whole = F.floor(scaled)
    near = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / float(10**places)
    near = F.when(scaled < float(1 << 52), near).when(scaled < float("inf"), scaled / float(10**places))
    return F.when(near.isNull(), x).when(x < 0, -near).otherwise(near)


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long, doubles rounded, so both engines agree on kinds and last digits."""
    kinds = dict(df.dtypes)
    out = {"int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long"), "double": lambda c: _round(c, 6), "float": lambda c: _round(c, 6)}
    return df.select(*[out[kinds[c]](c).alias(c) if kinds[c] in out else F.col(c) for c in df.columns])


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to so many places, as the SQL beside it does."""
    return df.select(*[_round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of Tables under a name, with SQL that may use the views."""
    def keep(f):
        _QUERIES[name] = lambda spark, folder: _plain(f(Tables(spark, folder)))
        if sql is not None:
            head = "WITH RECURSIVE" if recursive else "WITH"
            body = sql.strip()
            _SQL[name] = f"{head} {VIEWS}, {body[5:]}" if body.startswith("WITH ") else f"{head} {VIEWS} {body}"
        return f

    return keep


def _load() -> None:
    from . import queries_doors, queries_evaluation, queries_navigation, queries_raster, queries_stateful, queries_voxels  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
