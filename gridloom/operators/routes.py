"""Shortest ways over edge tables, and the next target of a robot on its map of rooms and doors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, release, scratch


def shortest_ways(edges: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, distance, before): the least sum of weights from a source of the graph, and the node before on such a way (the smallest; null at a source).

    edges: (keys, a, b, weight), directed, weights above zero; others are left
    out. Rounds of relaxation: only nodes that came nearer send on, so there
    are as many rounds as edges on the longest of the shortest ways. Nodes out of reach have no row.
    """
    with scratch() as keep:
        links = cut(edges.where("a is not null and b is not null and weight > 0").groupBy(*keys, "a", "b").agg(F.min(F.col("weight").cast("double")).alias("weight")), "links")
        known = front = cut(sources.select(*keys, "node", F.lit(0.0).alias("distance")).distinct(), "known")
        while True:
            sent = front.withColumnRenamed("node", "a").join(links, [*keys, "a"]).groupBy(*keys, F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
            nearer = sent.join(known, [*keys, "node"], "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance")))
            step = cut(nearer.select(*keys, "node", F.col("new").alias("distance")), "front")
            if step.isEmpty():
                break
            both = cut(known.join(step.select(*keys, "node"), [*keys, "node"], "left_anti").unionByName(step), "known")
            release(known)
            known, front = both, step
        into = known.select(*keys, F.col("node").alias("a"), F.col("distance").alias("da")).join(links, [*keys, "a"]).withColumnRenamed("b", "node").join(known, [*keys, "node"])
        before = into.where(F.col("da") + F.col("weight") == F.col("distance")).groupBy(*keys, "node").agg(F.min("a").alias("before"))
        return keep(cut(known.join(before, [*keys, "node"], "left").select(*keys, "node", "distance", "before"), "ways"))


def next_targets(agents: DataFrame, frontiers: DataFrame, nodes: DataFrame, waypoints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target_r, target_c, reason, done) for each agent (keys, r, c, escaped).

    Escaped: to the nearest waypoint of a door (keys, r, c). Else to the
    largest frontier of its room (keys, size, distance, r, c), the nearer of equal ones; else to
    the nearest entry of an unexplored node (keys, node_id, status, r, c); else done.
    Ties go to the smaller id, row and column.
    """
    at = agents.select(*keys, F.col("r").alias("ar"), F.col("c").alias("ac"), F.coalesce("escaped", F.lit(False)).alias("escaped"))
    far = F.sqrt(F.pow(F.col("r") - F.col("ar"), 2) + F.pow(F.col("c") - F.col("ac"), 2))
    largest = frontiers.groupBy(*keys).agg(F.min(F.struct((-F.col("size")).alias("s"), "distance", "r", "c")).alias("f"))
    unseen = nodes.where("status = 'Unexplored' and r is not null and c is not null").join(at, keys)
    entry = unseen.groupBy(*keys).agg(F.min(F.struct(far.alias("d"), "node_id", "r", "c")).alias("n"))
    doors = waypoints.where("r is not null and c is not null").join(at.where("escaped"), keys).groupBy(*keys).agg(F.min(F.struct(far.alias("d"), "r", "c")).alias("w"))
    rows = at.join(largest, keys, "left").join(entry, keys, "left").join(doors, keys, "left")
    reason = F.when(F.col("escaped"), "escape").when(F.col("f").isNotNull(), "current_room_frontier").when(F.col("n").isNotNull(), "nearest_unexplored").otherwise("done")
    pick = lambda x: F.when(F.col("escaped"), F.col(f"w.{x}")).otherwise(F.coalesce(f"f.{x}", f"n.{x}"))
    return rows.select(*keys, pick("r").alias("target_r"), pick("c").alias("target_c"), reason.alias("reason")).withColumn("done", F.col("target_r").isNull())
