"""A registry of terminated targets as typed streaming state: suppression in a neighbourhood until records expire, snapshots, and streams that start from one.

State is kept by scene and tile, so it spreads with the maps and not with the
number of scenes; a record stands in every tile that its radius reaches, a query looks at its
own. Each tile has a map from (place, target) to the last step at which the
record holds. Expired records go whenever their tile is met.

Spark's typed state needs its RocksDB state store:
`spark.sql.streaming.stateStore.providerClass` = PROVIDER.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["scene", "tile_r", "tile_c"]
RECORD = "r double, c double, target_r long, target_c long"
#: A snapshot's rows: a record of a tile and the last step at which it holds.
SNAPSHOT = f"tile_r long, tile_c long, {RECORD}, until long"
OUTPUT = "step long, query_id long, suppressed boolean"
#: A target that is none, as a map's key holds no nulls.
NO_TARGET = -(1 << 62)


def tiled(rows: DataFrame, radius: float, tile: int) -> DataFrame:
    """Rows (scene, step, query_id, kind, r, c, target_r, target_c, suppress_steps) with their tiles: a query in its own, a mark in all within reach."""
    at = lambda x, d: F.floor((F.col(x) + d) / tile).cast("long")
    reach = F.when(F.col("kind") == "mark", radius).otherwise(0.0)
    spread = lambda x: F.explode(F.sequence(at(x, -reach), at(x, reach)))
    target = lambda x: F.coalesce(F.floor(x).cast("long"), F.lit(NO_TARGET)).alias(x)
    out = rows.withColumn("tile_r", spread("r")).withColumn("tile_c", spread("c"))
    return out.select(*KEY, F.col("step").cast("long"), F.col("query_id").cast("long"), "kind", F.col("r").cast("double"), F.col("c").cast("double"), target("target_r"), target("target_c"), F.coalesce("suppress_steps", F.lit(0)).cast("long").alias("suppress_steps"))


class Registry(StatefulProcessor):
    """One tile's records."""

    def __init__(self, radius: float):
        self.radius = radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", RECORD, "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["step", "query_id"], kind="stable")
        held = {tuple(k): v[0] for k, v in self.records.iterator()}
        out, steps = [], []
        for step, some in pdf.groupby("step", sort=True):
            steps.append(step)
            live = [k for k, until in held.items() if until >= step]
            for q in some[some["kind"] == "query"].itertuples():
                target = (q.target_r, q.target_c)
                near = any(k[2:] == target and math.dist(k[:2], (q.r, q.c)) <= self.radius for k in live)
                out.append((*key, step, q.query_id, near))
            for m in some[some["kind"] == "mark"].itertuples():
                place = (m.r, m.c, m.target_r, m.target_c)
                held[place] = max(held.get(place, -1), step + m.suppress_steps)
        for place, until in held.items():
            if until >= steps[-1]:
                self.records.updateValue(place, (until,))
            elif self.records.containsKey(place):
                self.records.removeKey(place)
        yield pd.DataFrame(out, columns=["scene", "tile_r", "tile_c", "step", "query_id", "suppressed"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for x in initialState.itertuples():
            self.records.updateValue((x.r, x.c, x.target_r, x.target_c), (x.until,))

    def close(self) -> None:
        pass


def suppressed(rows: DataFrame, radius: float = 1.0, tile: int = 8, snapshot: DataFrame | None = None) -> DataFrame:
    """(scene, tile, step, query_id, suppressed) of the queries of a stream; steps of a scene arrive in order. snapshot: records to start from."""
    kind = dict(rows.dtypes)["scene"]
    initial = None if snapshot is None else snapshot.groupBy(*KEY)
    return tiled(rows, radius, tile).groupBy(*KEY).transformWithStateInPandas(Registry(radius), f"scene {kind}, tile_r long, tile_c long, {OUTPUT}", "append", "none", initialState=initial)


def exported(spark: SparkSession, checkpoint: str, since: int = 0) -> DataFrame:
    """(scene, tile_r, tile_c, r, c, target_r, target_c, until): the records of a stream's checkpoint that hold at a step or later; tiles that were not met lately may have older ones."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "records").load()
    return state.select(*[F.col(f"key.{k}").alias(k) for k in KEY], "user_map_key.*", F.col("user_map_value.until").alias("until")).where(F.col("until") >= since)
