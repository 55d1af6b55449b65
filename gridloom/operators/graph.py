"""Scene graphs as node and edge tables: subgraphs by object, affiliation edges, candidate credibility."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def subgraphs(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, center, members, edges): each object with its neighbours, its room and group, and the edges among them.

    nodes: (keys, node_id, kind, room_id, group_id); edges: (keys, a, b).
    """
    objects = nodes.where("kind = 'object'")
    own = objects.select(*keys, F.col("node_id").alias("center"), F.explode(F.array_compact(F.array("node_id", "room_id", "group_id"))).alias("member"))
    both = edges.select(*keys, F.col("a").alias("center"), F.col("b").alias("member")).union(edges.select(*keys, F.col("b").alias("center"), F.col("a").alias("member")))
    members = own.union(both.join(objects.select(*keys, F.col("node_id").alias("center")), [*keys, "center"], "left_semi")).distinct()
    inside = edges.join(members.withColumnRenamed("member", "a"), [*keys, "a"]).join(members.withColumnRenamed("member", "b"), [*keys, "center", "b"])
    lists = inside.groupBy(*keys, "center").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("edges"))
    return members.groupBy(*keys, "center").agg(F.sort_array(F.collect_list("member")).alias("members")).join(lists, [*keys, "center"], "left")


def affiliation(objects: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, room_id, confidence): object to room, and group to room where all members agree. groups: (keys, group_id, object_id)."""
    direct = objects.where("room_id is not null").select(*keys, F.col("object_id").alias("source"), "room_id", "confidence")
    votes = groups.join(objects, [*keys, "object_id"], "left").groupBy(*keys, "group_id").agg(F.count_distinct("room_id").alias("rooms"), F.count(F.when(F.col("room_id").isNull(), 1)).alias("without"), F.min("room_id").alias("room_id"), F.avg("confidence").alias("confidence"))
    return direct.unionByName(votes.where("rooms = 1 and without = 0").select(*keys, F.col("group_id").alias("source"), "room_id", "confidence"))


def credibility(candidates: DataFrame, terms: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Detector confidence times the sum of p / distance over a frame's subgraphs."""
    d = F.greatest(scalar.distance(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")), F.lit(eps))
    rows = candidates.join(terms.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), "p"), keys)
    return rows.groupBy(*keys, "candidate_id", "confidence").agg(F.sum(F.col("p") / d).alias("evidence")).withColumn("credibility", F.col("confidence") * F.col("evidence"))


def label_distribution(observations: DataFrame, keys: list[str]) -> DataFrame:
    """By node: confidence sums and hits of each class, natural-log entropy of the sums, and the best class (ties by name)."""
    by = observations.groupBy(*keys, "category").agg(F.sum("confidence").alias("total"), F.count("*").alias("hits"))
    share = F.col("total") / F.sum(F.when(F.col("total") > 0, F.col("total"))).over(Window.partitionBy(*keys))
    by = by.withColumn("term", F.when(F.col("total") > 0, -share * F.ln(share)).otherwise(0.0))
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", c))))
    return by.groupBy(*keys).agg(entries("total").alias("totals"), entries("hits").alias("hits"), F.sum("term").alias("entropy"), F.min(F.struct((-F.col("total")).alias("o"), "category")).alias("b")).select(*keys, "totals", "hits", "entropy", F.col("b.category").alias("category"))


def fallback_scores(subgraph: DataFrame, goal: str, words: dict[str, list[str]]) -> DataFrame:
    """Scores without a model: 1 for the goal among the members' categories, 0.5 for a related one, 0.1 otherwise."""
    related = F.array(*[F.lit(w) for w in words.get(goal, [])]).cast("array<string>")
    return subgraph.withColumn("p", F.when(F.array_contains("categories", goal), 1.0).when(F.arrays_overlap("categories", related), 0.5).otherwise(0.1))


def unobstructed_pairs(objects: DataFrame, obstacles: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Pairs of objects of a room within a distance whose straight line meets no obstacle. objects: (keys, point_id, room_id, x, y), in cells.

    An object brings the obstacles of the nine blocks about it, a bit a cell; a
    line lies within them, so neither pairs nor their cells are shuffled.
    """
    from .matching import pairs_within
    from .raster import spread

    side = math.ceil(most) + 2
    words = math.ceil(side * side / 64)
    blocks = [F.floor(F.col(x) / side).alias(f"block_{x}") for x in "rc"]
    inside = F.pmod("r", F.lit(side)) * side + F.pmod("c", F.lit(side))
    own = obstacles.select(*keys, *blocks, inside.alias("i"))
    own = own.groupBy(*keys, "block_r", "block_c", F.shiftright("i", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("bits"))
    around = F.explode(F.array(*[F.struct(F.lit(a - 1).alias("dr"), F.lit(b - 1).alias("dc"), F.lit((3 * (2 - a) + 2 - b) * words).alias("at")) for a in range(3) for b in range(3)])).alias("o")
    near = own.select("*", around).select(*keys, (F.col("block_r") + F.col("o.dr")).alias("block_r"), (F.col("block_c") + F.col("o.dc")).alias("block_c"), (F.col("o.at") + F.col("word")).cast("int").alias("at"), "bits")
    near = near.groupBy(*keys, "block_r", "block_c").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    near = near.select(*keys, "block_r", "block_c", F.transform(F.sequence(F.lit(0), F.lit(9 * words - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("walls"))
    placed = objects.withColumn("r", F.col("y").cast("int")).withColumn("c", F.col("x").cast("int")).select("*", *blocks)
    placed = placed.join(spread(near), [*keys, "block_r", "block_c"], "left")
    pairs = pairs_within(placed, most, (*keys, "room_id"), ("r", "c"), ("block_r", "block_c", "walls"))

    pairs = pairs.withColumn("walls", F.coalesce("walls", F.array_repeat(F.lit(0).cast("long"), 9 * words)))
    names = [*keys, "a", "b", "room_id", "distance"]

    def clear(batches):
        """The pairs no cell of whose line_cells is an obstacle."""
        for batch in batches:
            ra, ca, rb, cb, br, bc = (batch.column(n).to_numpy().astype(np.int64) for n in ("r_a", "c_a", "r_b", "c_b", "block_r", "block_c"))
            walls = batch.column("walls").flatten().to_numpy().reshape(batch.num_rows, 9 * words)
            n, rows, hit = np.maximum(np.abs(rb - ra), np.abs(cb - ca)), np.arange(batch.num_rows), np.zeros(batch.num_rows, bool)
            for step in range(n.max(initial=-1) + 1):
                i = np.minimum(step, n)
                r, c = (np.rint(x + (y - x) * i / np.maximum(n, 1)).astype(np.int64) - (z - 1) * side for x, y, z in ((ra, rb, br), (ca, cb, bc)))
                cell = r % side * side + c % side
                hit |= walls[rows, (r // side * 3 + c // side) * words + (cell >> 6)] >> (cell & 63) & 1 != 0
            yield batch.filter(pa.array(~hit)).select(names)

    pairs = pairs.select(*names, "r_a", "c_a", "r_b", "c_b", "block_r", "block_c", "walls")
    return pairs.mapInArrow(clear, pairs.select(*names).schema)
