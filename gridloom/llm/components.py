"""Connected components of an edge table by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) shrink every component
to a star around its smallest node in a logarithmic number of rounds. A node's
minimum is aggregated before it is joined back, so a node with very many
links costs no more than its links; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        turned = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = turned.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = turned.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a <> b; root is the component's smallest node."""
    now = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        half = stash(_star(now, True), "large")
        release(now)
        now = stash(_star(half, False), "small")
        release(half)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
