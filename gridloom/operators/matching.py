"""Joins by nearness: as-of picks, nearest neighbours, epsilon groups, boxes and polygons over cells.

Distance joins meet by tiles of the radius (own tile and neighbours), so they
are equal joins with a test, never products of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .raster import spread, star_roots


def last_snapshot(snapshots: DataFrame, reported: DataFrame, keys: list[str], step: str = "step", final: str = "final_step") -> DataFrame:
    """By key the greatest step up to the reported one, else the nearest after it, else the greatest; with its status."""
    rows = snapshots.select(*keys, step).join(reported.select(*keys, final), keys, "left")
    s, f = F.col(step), F.col(final)
    upto = f.isNull() | (s <= f)
    rank = F.struct(F.when(upto, 0).otherwise(1).alias("tier"), F.when(upto, -s).otherwise(s).alias("place"))
    best = rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), s.alias("step"), f.alias("final"))).alias("b"))
    status = F.when(F.col("b.final").isNull(), "snapshot_only").when(F.col("b.step") == F.col("b.final"), "exact").when(F.col("b.step") < F.col("b.final"), "within_final").otherwise("nearest_after_final")
    return best.select(*keys, F.col("b.step").alias(step), status.alias("status"))


def linked(method: DataFrame, truth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Snapshots joined to their truth, and those without any."""
    return method.join(truth, keys), method.join(truth.select(*keys).distinct(), keys, "left_anti")


def _tiled(df: DataFrame, size: float, x: str, y: str, around: bool) -> DataFrame:
    tx, ty = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("tile_x", tx).withColumn("tile_y", ty)
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return df.withColumn("__o", offsets).withColumn("tile_x", tx + F.col("__o.a")).withColumn("tile_y", ty + F.col("__o.b")).drop("__o")


def nearest(queries: DataFrame, points: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, point_id, distance): the nearest point strictly within the radius, the smallest id at a tie.

    queries: (keys, query_id, x, y); points: (keys, point_id, x, y). Places meet
    places: of equal points the smallest id stands for all, and queries take what their place found.
    """
    places = queries.select(*keys, F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()
    first = points.groupBy(*keys, "x", "y").agg(F.min("point_id").alias("point_id"))
    d = scalar.distance(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
    near = _tiled(places, radius, "qx", "qy", True).join(_tiled(first, radius, "x", "y", False), [*keys, "tile_x", "tile_y"]).withColumn("distance", d).where(F.col("distance") < radius)
    best = near.groupBy(*keys, F.col("qx").alias("x"), F.col("qy").alias("y")).agg(F.min(F.struct("distance", "point_id")).alias("b"))
    found = queries.select(*keys, "query_id", "x", "y").join(best, [*keys, "x", "y"]).groupBy(*keys, "query_id").agg(F.min("b").alias("b"))
    return found.select(*keys, "query_id", "b.point_id", "b.distance")


def pairs_within(points: DataFrame, radius: float, keys: tuple[str, ...] = (), carried: tuple[str, ...] = (), of_b: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, distance) of points at most the radius apart, a < b; carried columns of both as name_a and name_b and those of b alone, so pairs need not be joined with their points again."""
    more = lambda end: [F.col(x).alias(f"{x}_{end}") for x in carried]
    left = _tiled(points.select(*keys, F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *more("a")), radius, "ax", "ay", True)
    right = _tiled(points.select(*keys, F.col("point_id").alias("b"), "x", "y", *more("b"), *of_b), radius, "x", "y", False)
    d = scalar.distance(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    return spread(left).join(right, [*keys, "tile_x", "tile_y"]).where("a < b").withColumn("distance", d).where(F.col("distance") <= radius).select(*keys, "a", "b", "distance", *[f"{x}_{end}" for end in "ab" for x in carried], *of_b)


def epsilon_groups(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Points with the smallest id of their chain of neighbours, and the group's mean centre."""
    roots = star_roots(pairs_within(points, radius, tuple(keys)).select(*keys, "a", "b"), keys)
    named = points.join(roots.withColumnRenamed("node", "point_id"), [*keys, "point_id"], "left").withColumn("group_id", F.coalesce("root", "point_id")).drop("root")
    centre = named.groupBy(*keys, "group_id").agg(F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"), F.count("*").alias("members"))
    return named.join(centre, [*keys, "group_id"])


def polygon_cells(polygons: DataFrame, keys: list[str], resolution: float, min_x: float, max_y: float) -> DataFrame:
    """(keys, polygon_id, r, c) of cells whose centre lies in a polygon; only the cells of its bounding box are tried."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    r0, r1 = F.floor((max_y - F.array_max(ys)) / resolution), F.floor((max_y - F.array_min(ys)) / resolution)
    c0, c1 = F.floor((F.array_min(xs) - min_x) / resolution), F.floor((F.array_max(xs) - min_x) / resolution)
    rows = polygons.where(F.size("points") >= 3).withColumn("r", F.explode(F.sequence(r0, r1))).withColumn("c", F.explode(F.sequence(c0, c1)))
    x, y = min_x + (F.col("c") + 0.5) * resolution, max_y - (F.col("r") + 0.5) * resolution
    return rows.where(scalar.point_in_polygon(x, y, F.col("points"))).select(*keys, "polygon_id", "r", "c")


def room_of_points(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the smallest id of a polygon that holds them, null where none does. Bounding boxes come first."""
    boxes = polygons.withColumn("xs", F.transform("points", lambda p: p["x"])).withColumn("ys", F.transform("points", lambda p: p["y"]))
    on = (F.col("x").between(F.array_min("xs"), F.array_max("xs"))) & (F.col("y").between(F.array_min("ys"), F.array_max("ys"))) & scalar.point_in_polygon(F.col("x"), F.col("y"), F.col("points"))
    hit = points.join(boxes, keys).where(on).groupBy(*keys, "point_id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.join(hit, [*keys, "point_id"], "left")


def box_cells(boxes: DataFrame, keys: list[str], z_low: float, z_high: float, height: int, width: int, openings: DataFrame | None = None) -> DataFrame:
    """Cells of boxes (keys, r0, r1, c0, c1, z0, z1) that reach into a band of heights, less the cells of openings."""
    def cells(b: DataFrame) -> DataFrame:
        rows = b.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("r0")), F.least(F.lit(height - 1), F.col("r1")))))
        return rows.withColumn("c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c0")), F.least(F.lit(width - 1), F.col("c1"))))).select(*keys, "r", "c").distinct()

    on_map = (F.col("r1") >= 0) & (F.col("r0") < height) & (F.col("c1") >= 0) & (F.col("c0") < width)
    solid = cells(boxes.where((F.col("z0") < z_high) & (F.col("z1") > z_low) & on_map))
    return solid if openings is None else solid.join(cells(openings.where(on_map)), [*keys, "r", "c"], "left_anti")


def rooms_of_objects(objects: DataFrame, rooms: DataFrame, keys: list[str], margin: float = 0.1) -> DataFrame:
    """(keys, object_id, label, share, ambiguous): the room with most of an object's cells; ambiguous where the next is within the margin."""
    overlap = objects.join(rooms, [*keys, "r", "c"]).groupBy(*keys, "object_id", "label").count()
    size = objects.groupBy(*keys, "object_id").agg(F.count("*").alias("cells"))
    order = Window.partitionBy(*keys, "object_id").orderBy(F.desc("count"), "label")
    ranked = overlap.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("count").over(order)).where("rank = 1")
    out = size.join(ranked, [*keys, "object_id"], "left")
    share = F.col("count") / F.col("cells")
    return out.select(*keys, "object_id", "label", F.coalesce(share, F.lit(0.0)).alias("share"), F.coalesce((F.col("count") - F.coalesce("next", F.lit(0))) / F.col("cells") < margin, F.lit(False)).alias("ambiguous"))


def suppressed(frontiers: DataFrame, records: DataFrame, keys: list[str], radius: float, bucket: int = 16) -> DataFrame:
    """Frontiers without an unexpired terminal record near: records hold while step <= until_step.

    frontiers: (keys, frontier_id, step, x, y); records: (keys, record_id, x, y, step, until_step). They meet by
    tiles of the radius and buckets of steps, a record in each bucket of its life, so pairs do not grow with the length of the run.
    """
    part = lambda c: F.floor(F.col(c) / bucket)
    left = _tiled(frontiers.select(*keys, "frontier_id", F.col("step").alias("at"), part("step").alias("bucket"), F.col("x").alias("fx"), F.col("y").alias("fy")), radius, "fx", "fy", True)
    lives = records.where("step <= until_step").select(*keys, "x", "y", "until_step", F.col("step").alias("since"), F.explode(F.sequence(part("step"), part("until_step"))).alias("bucket"))
    hit = left.join(_tiled(lives, radius, "x", "y", False), [*keys, "bucket", "tile_x", "tile_y"]).where((F.col("since") <= F.col("at")) & (F.col("at") <= F.col("until_step")) & (scalar.distance(F.col("x") - F.col("fx"), F.col("y") - F.col("fy")) <= radius))
    return frontiers.join(hit.select(*keys, "frontier_id").distinct(), [*keys, "frontier_id"], "left_anti")


def frontier_scores(frontiers: DataFrame, subgraphs: DataFrame, keys: list[str], top: int = 3, eps: float = 1e-6, block: int = 256) -> DataFrame:
    """(keys, frontier_id, score, contributors): the sum of p / distance over a frame's subgraphs, and its largest terms.

    The score is a sum over all of a frame's subgraphs, so every frontier meets
    every subgraph of its own frame, a block of them at a time: only a block's sum and largest terms are shuffled, no pair.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("subgraph_id"))
    blocks = subgraphs.withColumn("__block", F.floor(number / block)).groupBy(*keys, "__block").agg(F.collect_list(F.struct(F.col("subgraph_id"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("p"))).alias("subgraphs"))

    def term(s):
        t = s["p"] / F.greatest(scalar.distance(F.col("x") - s["sx"], F.col("y") - s["sy"]), F.lit(eps))
        # the largest first, not a number before all, null after all
        return F.struct(t.isNull().alias("none"), (~F.coalesce(F.isnan(t), F.lit(False))).alias("number"), (-t).alias("order"), s["subgraph_id"].alias("subgraph_id"), t.alias("term"))

    def summed(terms):
        total = F.aggregate(terms, F.lit(None).cast("double"), lambda n, s: F.when(s["none"], n).otherwise(F.coalesce(n, F.lit(0.0)) + s["term"]))
        return F.struct(total.alias("score"), F.slice(terms, 1, top).alias("terms"))

    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    rows = frontiers.join(spread(blocks), keys).select(*keys, "frontier_id", let(F.sort_array(F.transform("subgraphs", term)), summed).alias("s"))
    found = rows.groupBy(*keys, "frontier_id").agg(F.sum("s.score").alias("score"), F.slice(F.sort_array(F.flatten(F.collect_list("s.terms"))), 1, top).alias("terms"))
    return found.select(*keys, "frontier_id", "score", F.transform("terms", lambda s, i: F.struct((i + 1).alias("rank"), s["subgraph_id"].alias("subgraph_id"), s["term"].alias("term"))).alias("contributors"))


def door_pairs(points: DataFrame, free: DataFrame, keys: list[str], least: float, most: float, free_ratio: float = 0.45) -> DataFrame:
    """(keys, a, b, width, ratio): door points a width apart whose connecting line is mostly free. points: (keys, point_id, x, y), in cells."""
    from .raster import line_cells

    near = pairs_within(points, most, tuple(keys)).where(F.col("distance") >= least)
    end = lambda n: points.select(*keys, F.col("point_id").alias(n), F.col("y").cast("int").alias(f"r_{n}"), F.col("x").cast("int").alias(f"c_{n}"))
    lines = near.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"])
    cells = lines.select(*keys, "a", "b", "distance", F.explode(line_cells(F.col("r_a"), F.col("c_a"), F.col("r_b"), F.col("c_b"))).alias("p")).select(*keys, "a", "b", "distance", "p.r", "p.c")
    hit = cells.join(free.select(*keys, "r", "c").distinct().withColumn("free", F.lit(1)), [*keys, "r", "c"], "left")
    out = hit.groupBy(*keys, "a", "b", "distance").agg((F.sum(F.coalesce("free", F.lit(0))) / F.count("*")).alias("ratio"))
    return out.where(F.col("ratio") >= free_ratio).withColumnRenamed("distance", "width")


def spaced(scored: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Score-ordered suppression by radius: of the points of a frame the best stays, those near it go, and so on (ties by id)."""
    def keep(pdf):
        order = pdf.sort_values(["score", "point_id"], ascending=[False, True])
        kept: list = []
        for row in order.itertuples():
            if all((row.x - k.x) ** 2 + (row.y - k.y) ** 2 > radius * radius for k in kept):
                kept.append(row)
        return pdf[pdf["point_id"].isin([k.point_id for k in kept])]

    return scored.groupBy(*keys).applyInPandas(keep, scored.schema)

