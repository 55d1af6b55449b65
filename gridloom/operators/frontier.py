"""Frontiers and choices: frontier cells, clusters with centres, nearest and random picks, sticky gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import raster


def frontier_cells(free: DataFrame, obstacles: DataFrame, unknown: DataFrame, keys: list[str], height: int, width: int, obstacle_radius: int = 4, unknown_radius: int = 1, excluded: DataFrame | None = None) -> DataFrame:
    """Free cells away from obstacles and next to the unknown, less the excluded."""
    away = raster.minus(free.select(*keys, "r", "c"), raster.dilate(obstacles, keys, raster.disk(obstacle_radius), height, width), keys)
    near = raster.both(away, raster.dilate(unknown, keys, raster.disk(unknown_radius), height, width), keys)
    return near if excluded is None else raster.minus(near, excluded, keys)


def clusters(cells: DataFrame, keys: list[str], width: int, least: int = 1, connectivity: int = 8) -> DataFrame:
    """(keys, label, size, r, c, members): the centre is the member nearest the mean, the first at a tie."""
    labelled = raster.components(cells, keys, width, connectivity)
    mean = labelled.groupBy(*keys, "label").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"), F.count("*").alias("size")).where(F.col("size") >= least)
    rows = labelled.join(raster.spread(mean), [*keys, "label"])
    d2 = F.round(F.pow(F.col("r") - F.col("mr"), 2) + F.pow(F.col("c") - F.col("mc"), 2), 9)
    best = rows.groupBy(*keys, "label", "size").agg(F.min(F.struct(d2.alias("d2"), "r", "c")).alias("b"), F.sort_array(F.collect_list(F.struct("r", "c"))).alias("members"))
    return best.select(*keys, "label", "size", "b.r", "b.c", "members")


def with_distance(found: DataFrame, field: DataFrame, keys: list[str], mode: str = "min") -> DataFrame:
    """Clusters with the distance of their members (min or mean) or of their centre; clusters that can't be reached go."""
    if mode == "center":
        return found.join(field.select(*keys, "r", "c", "distance"), [*keys, "r", "c"])
    members = found.select(*keys, "label", F.explode("members").alias("m")).select(*keys, "label", "m.r", "m.c")
    agg = {"min": F.min("distance"), "mean": F.avg("distance")}[mode]
    near = raster.spread(members).join(field.select(*keys, "r", "c", "distance"), [*keys, "r", "c"]).groupBy(*keys, "label").agg(agg.alias("distance"))
    return found.join(raster.spread(near), [*keys, "label"])


def ranked(found: DataFrame, keys: list[str], least_distance: float = 0.0, most: int = 50) -> DataFrame:
    """The nearest clusters not under the least distance; where all are under it, the nearest of those."""
    far = F.max(F.col("distance") >= least_distance).over(Window.partitionBy(*keys))
    rows = found.withColumn("__far", far).where(~F.col("__far") | (F.col("distance") >= least_distance)).drop("__far")
    order = Window.partitionBy(*keys).orderBy("distance", "label")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def random_choice(found: DataFrame, keys: list[str], seed: int, ident: str = "label") -> DataFrame:
    """One cluster of each frame, by the order of a seeded hash."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, ident), ident)
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def sampled_cells(cells: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most so many cells of each frame, evenly through raster order."""
    order = Window.partitionBy(*keys).orderBy("r", "c")
    rows = cells.withColumn("__n", F.row_number().over(order) - 1).withColumn("__all", F.count("*").over(Window.partitionBy(*keys)))
    step = F.greatest(F.lit(1), F.ceil(F.col("__all") / most))
    return rows.where(F.col("__n") % step == 0).drop("__n", "__all")


def approach_cells(frontiers: DataFrame, field: DataFrame, keys: list[str], radius: int, clearance: str = "clearance", least: float = 0.0) -> DataFrame:
    """The best reachable cell near each frontier's centre: enough clearance, then nearest to the centre, then shortest way."""
    near = frontiers.select(*keys, "label", F.col("r").alias("fr"), F.col("c").alias("fc"), raster.offset_table(raster.disk(radius)).alias("o"))
    near = near.select(*keys, "label", (F.col("fr") + F.col("o.dr")).alias("r"), (F.col("fc") + F.col("o.dc")).alias("c"), (F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc")).alias("d2"))
    hit = raster.spread(near).join(field.where(F.col(clearance) >= least), [*keys, "r", "c"])
    return hit.groupBy(*keys, "label").agg(F.min(F.struct("d2", "distance", "r", "c")).alias("b")).select(*keys, "label", "b.r", "b.c", "b.distance", "b.d2")


def goal_cells_with_clearance(goals: DataFrame, field: DataFrame, keys: list[str], least: float, radius: int) -> DataFrame:
    """Goal cells with enough clearance; a frame without any takes the cells around its goals that have it."""
    clear = field.where(F.col("clearance") >= least).select(*keys, "r", "c")
    direct = raster.both(goals.select(*keys, "r", "c"), clear, keys).withColumn("source", F.lit("goal"))
    around = raster.both(raster.moved(goals, keys, raster.disk(radius)).distinct(), clear, keys).withColumn("source", F.lit("search"))
    return direct.unionByName(around.join(direct.select(*keys).distinct(), keys, "left_anti"))


def room_context(members: DataFrame, rooms: DataFrame, keys: list[str], radius: int, least_ratio: float = 0.2) -> DataFrame:
    """(keys, frontier_id, label, ratio): the room with the largest share of labelled cells in disks around a frontier's members, if large enough."""
    disk = members.select(*keys, "frontier_id", "r", "c", raster.offset_table(raster.disk(radius)).alias("o"))
    disk = disk.select(*keys, "frontier_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
    votes = raster.spread(disk).join(rooms.where("label > 0"), [*keys, "r", "c"]).groupBy(*keys, "frontier_id", "label").count()
    total = F.sum("count").over(Window.partitionBy(*keys, "frontier_id"))
    order = Window.partitionBy(*keys, "frontier_id").orderBy(F.desc("count"), "label")
    best = votes.withColumn("ratio", F.col("count") / total).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.where(F.col("ratio") >= least_ratio).select(*keys, "frontier_id", "label", "ratio")


def update_gate(**state: Column) -> Column:
    """(update, reason) by the first rule that holds; rules in order, state columns are booleans."""
    rules = [("legacy", True), ("forced", True), ("initial", True), ("pending_refresh", True), ("cooldown", False), ("arrived", True), ("reached", True), ("invalidated", True), ("no_progress", True), ("no_path", True)]
    out = None
    for name, update in rules:
        if name in state:
            pair = F.struct(F.lit(update).alias("update"), F.lit(name).alias("reason"))
            out = F.when(state[name], pair) if out is None else out.when(state[name], pair)
    cached = F.struct(F.lit(False).alias("update"), F.lit("cached").alias("reason"))
    return cached if out is None else out.otherwise(cached)
