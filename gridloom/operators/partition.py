"""Partitions of free ground as tables: region graphs merged in rounds, parts cut at bottlenecks, cuts from wall to wall across narrow places.

Tables are small on disk and large in memory, so none is broadcast.
Rounds work on region graphs or on the cells still in play and end when nothing
changes; each is a written table. Loops run as often as a chain of merges or a
spur is long, never once a cell or region.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, release, scratch
from . import labels as label_ops
from . import raster

AROUND = [(r, c) for r, c in raster.square(1) if (r, c) != (0, 0)]


def pruned(cells: DataFrame, keys: list[str], rounds: int, least_degree: int = 2) -> DataFrame:
    """cells without the ends that are peeled off, all at once, in so many rounds: those with fewer neighbours (of eight) than least_degree."""
    now = cut(cells.select(*keys, "r", "c").distinct(), "peel")
    for _ in range(rounds):
        degree = raster.moved(now, keys, AROUND).groupBy(*keys, "r", "c").count()
        kept = cut(now.join(raster.spread(degree.where(F.col("count") >= least_degree)), [*keys, "r", "c"], "left_semi"), "peel")
        done = kept.count() == now.count()
        release(now)
        now = kept
        if done:
            break
    return now


def filled(labels: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """Labels spread through the domain by eight neighbours, a step a round; of several the smallest arrives. Cells out of reach have no row."""
    done = cut(labels.select(*keys, "r", "c", "label"), "filled")
    left = cut(raster.minus(domain.select(*keys, "r", "c").distinct(), done, keys), "left")
    front = done
    while True:
        fresh = cut(_spread(front, keys).join(raster.spread(left), [*keys, "r", "c"], "left_semi").groupBy(*keys, "r", "c").agg(F.min("label").alias("label")), "front")
        if fresh.isEmpty():
            return done
        rest = cut(raster.minus(left, fresh, keys), "left")
        both = cut(done.unionByName(fresh), "filled")
        for old in (left, done):
            release(old)
        left, done, front = rest, both, fresh


def _spread(labels: DataFrame, keys: list[str]) -> DataFrame:
    rows = labels.select(*keys, "r", "c", "label", raster.offset_table(AROUND).alias("o"))
    return rows.select(*keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "label")


def merged_regions(labels: DataFrame, keys: list[str], force_below: float, merge_below: float = 0.0, cell_area: float = 1.0, least_shared: float = 0.2, most_wall: float = 0.75) -> DataFrame:
    """(keys, r, c, label): small regions given to the neighbour with most border, by contraction of the region graph.

    Under force_below always; under merge_below where that border is more than
    least_shared of its sides, or where it has one neighbour and at most
    most_wall of its sides face none. In each round all regions that are
    smaller than each of their neighbours that would go, too, go at once (of
    equal ones the smaller label); their edges are added up anew. With
    force_below alone this is the result of merging the smallest region first,
    one at a time.
    """
    with scratch() as keep:
        edges = label_ops.adjacency(labels, keys)
        edges = cut(edges.union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "border")), "edges")
        shared = edges.groupBy(*keys, F.col("a").alias("label")).agg(F.sum("border").alias("shared"))
        regions = labels.where("label > 0").groupBy(*keys, "label").agg((F.count("*") * cell_area).alias("area")).join(raster.spread(label_ops.perimeters(labels, keys)), [*keys, "label"], "left").join(raster.spread(shared), [*keys, "label"], "left")
        regions = cut(regions.select(*keys, "label", "area", (F.coalesce("perimeter", F.lit(0)) - F.coalesce("shared", F.lit(0))).alias("outer")), "regions")
        names = cut(regions.select(*keys, "label", F.col("label").alias("root")), "names")
        while True:
            best = edges.groupBy(*keys, F.col("a").alias("label")).agg(F.min_by("b", F.struct(-F.col("border"), "b")).alias("to"), F.max("border").alias("most"), F.sum("border").alias("shared"), F.count("*").alias("n"))
            sides = F.greatest(F.lit(1), F.col("shared") + F.col("outer"))
            loose = (F.col("most") / sides > least_shared) | ((F.col("n") == 1) & (F.col("outer") / sides <= most_wall))
            going = cut(regions.join(raster.spread(best), [*keys, "label"]).where((F.col("area") < force_below) | ((F.col("area") < merge_below) & loose)).select(*keys, "label", "area", "to"), "going")
            rivals = edges.join(raster.spread(going.select(*keys, F.col("label").alias("b"), F.struct("area", "label").alias("size"))), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("size").alias("rival"))
            first = going.join(raster.spread(rivals), [*keys, "label"], "left").where(F.col("rival").isNull() | (F.struct("area", "label") < F.col("rival")))
            moves = cut(first.select(*keys, "label", "to"), "moves")
            if moves.isEmpty():
                break
            move = lambda df, c: df.join(raster.spread(moves.select(*keys, F.col("label").alias(c), F.col("to").alias("__to"))), [*keys, c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
            edges = cut(move(move(edges, "a"), "b").where("a <> b").groupBy(*keys, "a", "b").agg(F.sum("border").alias("border")), "edges")
            regions = cut(move(regions, "label").groupBy(*keys, "label").agg(F.sum("area").alias("area"), F.sum("outer").alias("outer")), "regions")
            names = cut(move(names, "root"), "names")
        out = labels.where("label > 0").join(raster.spread(names), [*keys, "label"]).select(*keys, "r", "c", F.col("root").alias("label"))
        return keep(cut(label_ops.relabelled(out, keys), "merged"))


def halved(labels: DataFrame, keys: list[str], least_side: int, narrow: float = 0.45, least_span: int = 8) -> DataFrame:
    """(keys, label, by_row, at): where a region has a row or column of at most `narrow` of its widest, with least_side cells on each side, spans of least_span lines or more: the narrowest such line, then the best balanced."""
    line = F.explode(F.array(F.struct(F.lit(False).alias("by_row"), F.col("c").alias("at")), F.struct(F.lit(True).alias("by_row"), F.col("r").alias("at"))))
    profile = labels.select(*keys, "label", line.alias("l")).select(*keys, "label", "l.*").groupBy(*keys, "label", "by_row", "at").count()
    every = Window.partitionBy(*keys, "label", "by_row")
    rows = profile.select("*", F.sum("count").over(every.orderBy("at")).alias("low"), F.sum("count").over(every).alias("all"), F.max("count").over(every).alias("widest"), (F.max("at").over(every) - F.min("at").over(every) + 1).alias("span"))
    rows = rows.where((F.col("span") >= least_span) & (F.col("count") <= narrow * F.col("widest")) & (F.col("low") >= least_side) & (F.col("all") - F.col("low") >= least_side))
    rank = F.struct("count", F.abs(2 * F.col("low") - F.col("all")), "by_row", "at")
    return rows.groupBy(*keys, "label").agg(F.min_by(F.struct("by_row", "at"), rank).alias("x")).select(*keys, "label", "x.by_row", "x.at")


def with_single_rooms_halved(labels: DataFrame, keys: list[str], width: int, least_side: int) -> DataFrame:
    """Components of one region alone are split at their bottleneck, if they have one; regions are numbered anew."""
    parts = raster.components(labels, keys, width).withColumnRenamed("label", "part")
    alone = labels.join(parts, [*keys, "r", "c"]).groupBy(*keys, "part").agg(F.countDistinct("label").alias("n"), F.min("label").alias("label")).where("n = 1").select(*keys, "label")
    at = halved(labels.join(alone, [*keys, "label"], "left_semi"), keys, least_side)
    rows = labels.join(at, [*keys, "label"], "left")
    beyond = F.coalesce(F.when(F.col("by_row"), F.col("r")).otherwise(F.col("c")) > F.col("at"), F.lit(False))
    highest = labels.groupBy(*keys).agg(F.max("label").alias("top"))
    rows = rows.join(highest, keys).select(*keys, "r", "c", (F.col("label") + F.when(beyond, F.col("top")).otherwise(0)).alias("label"))
    return label_ops.relabelled(rows, keys)


def wall_distance(free: DataFrame, keys: list[str], height: int, width: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """(keys, r, c, d2) of free cells to the nearest wall (null beyond the reach), and the walls that touch free ground."""
    walls = raster.minus(raster.dilate(free, keys, raster.square(1), height, width), free, keys)
    return raster.squared_distance(free, walls, keys, reach), walls


def ridge(distance: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, r, c, d2): cells at least as far from walls as all eight neighbours, and further than `least`."""
    here = distance.where(F.col("d2") > least * least)
    near = here.select(*keys, "r", "c", "d2", raster.offset_table(AROUND).alias("o")).select(*keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("d2").alias("near"))
    top = near.groupBy(*keys, "r", "c").agg(F.max("near").alias("near"))
    return here.join(raster.spread(top), [*keys, "r", "c"], "left").where(F.col("near").isNull() | (F.col("d2") >= F.col("near"))).select(*keys, "r", "c", "d2")


def _paired(points: DataFrame, others: DataFrame, keys: list[str], reach: int, names: list[str]) -> DataFrame:
    """Points with the others within a square of the reach: an equal join of tiles; the other's columns are suffixed _o."""
    tile = lambda c: F.floor(F.col(c) / reach)
    wide = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))
    left = points.withColumn("__tr", wide("r")).withColumn("__tc", wide("c"))
    right = others.select(*keys, tile("r").alias("__tr"), tile("c").alias("__tc"), *[F.col(n).alias(f"{n}_o") for n in names])
    return raster.spread(left).join(right, [*keys, "__tr", "__tc"]).drop("__tr", "__tc").where((F.abs(F.col("r") - F.col("r_o")) <= reach) & (F.abs(F.col("c") - F.col("c_o")) <= reach))


def _d2(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.pow(F.col(a[0]) - F.col(b[0]), 2) + F.pow(F.col(a[1]) - F.col(b[1]), 2)


def narrow_places(line: DataFrame, keys: list[str], stride: int) -> DataFrame:
    """The cells of a ridge (keys, r, c, d2) that are nearer to walls than all others within the stride; of equal ones the first in raster order."""
    rank = lambda *c: F.struct(*[F.col(x) for x in c])
    lower = _paired(line, line, keys, stride, ["r", "c", "d2"]).where(rank("d2_o", "r_o", "c_o") < rank("d2", "r", "c")).select(*keys, "r", "c").distinct()
    return line.join(raster.spread(lower), [*keys, "r", "c"], "left_anti")


def facing_walls(points: DataFrame, walls: DataFrame, keys: list[str], reach: int, least_angle: float) -> DataFrame:
    """(keys, r, c, d2, u, v, angle): each point's nearest wall and the nearest one that stands at least the angle from it, in degrees about the point."""
    near = _paired(points, walls, keys, reach, ["r", "c"]).withColumn("w2", _d2(("r", "c"), ("r_o", "c_o")))
    first = near.groupBy(*keys, "r", "c").agg(F.min(F.struct("w2", "r_o", "c_o")).alias("u"))
    both = near.join(raster.spread(first), [*keys, "r", "c"])
    ur, uc, vr, vc = F.col("u.r_o") - F.col("r"), F.col("u.c_o") - F.col("c"), F.col("r_o") - F.col("r"), F.col("c_o") - F.col("c")
    turn = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ur * vr + uc * vc) / F.sqrt(F.col("u.w2") * F.col("w2"))))))
    both = both.withColumn("angle", turn).where(F.col("angle") >= least_angle)
    found = both.groupBy(*keys, "r", "c", "d2").agg(F.first("u").alias("u"), F.min(F.struct("w2", "r_o", "c_o", "angle")).alias("v"))
    return found.select(*keys, "r", "c", "d2", F.struct(F.col("u.r_o").alias("r"), F.col("u.c_o").alias("c")).alias("u"), F.struct(F.col("v.r_o").alias("r"), F.col("v.c_o").alias("c")).alias("v"), F.col("v.angle").alias("angle"), (F.sqrt("u.w2") + F.sqrt("v.w2")).alias("length"))


def wall_to_wall(places: DataFrame, keys: list[str], spread: float, reach: int) -> DataFrame:
    """(keys, r, c): the cells of lines wall, place, wall. A place is left out where a better line (straighter, then shorter) has its place within spread times its own distance to walls."""
    better = F.struct(-F.col("angle_o"), "length_o", "r_o", "c_o") < F.struct(-F.col("angle"), "length", "r", "c")
    limit = F.greatest(F.lit(1.0), F.col("d2") * spread * spread)
    beaten = _paired(places, places, keys, max(1, math.ceil(reach * spread)), ["r", "c", "angle", "length"]).where(better & (_d2(("r", "c"), ("r_o", "c_o")) < limit)).select(*keys, "r", "c").distinct()
    kept = places.join(raster.spread(beaten), [*keys, "r", "c"], "left_anti")
    cells = F.explode(F.concat(*[raster.line_cells(F.col("r"), F.col("c"), F.col(f"{w}.r"), F.col(f"{w}.c")) for w in "uv"]))
    return kept.select(*keys, cells.alias("x")).select(*keys, "x.r", "x.c").distinct()


def voronoi_rooms(free: DataFrame, keys: list[str], height: int, width: int, resolution: float = 0.05, merge_below: float = 12.5, force_below: float = 2.0, low: float = 0.1, high: float = 1e6, stride: int = 20, spread: float = 0.5, least_angle: float = 95.0, least_distance: float = 1.0, prunings: int = 30, reach: int = 64) -> DataFrame:
    """(keys, r, c, label): rooms between cuts from wall to wall across the narrow places of the ridge between walls; areas in square metres.

    The ridge's ends are pruned; its places narrower than all within the stride
    are cut where two walls face each other over them. Regions of an allowed
    area fill the rest of the ground, and small ones are merged.
    """
    with scratch() as keep:
        free = cut(free.select(*keys, "r", "c").distinct(), "free")
        distance, walls = wall_distance(free, keys, height, width, reach)
        distance, walls = cut(distance, "distance"), cut(walls, "walls")
        line = cut(ridge(distance, keys, least_distance), "ridge")
        line = line.join(raster.spread(pruned(line, keys, prunings)), [*keys, "r", "c"], "left_semi")
        places = cut(facing_walls(narrow_places(line, keys, stride), walls, keys, reach, least_angle), "places")
        cuts = wall_to_wall(places, keys, spread, reach)
        found = raster.components(raster.minus(free, cuts, keys), keys, width)
        area = resolution * resolution
        good = raster.component_sizes(found, keys).where(F.col("area").cast("double") * area >= low).where(F.col("area").cast("double") * area <= high).select(*keys, "label")
        rooms = filled(found.join(raster.spread(good), [*keys, "label"], "left_semi").select(*keys, "r", "c", "label"), free, keys)
        # ground that no room of an allowed area reaches is its own
        rest = raster.components(raster.minus(free, rooms, keys), keys, width)
        top = rooms.groupBy(*keys).agg(F.max("label").alias("top"))
        rest = rest.join(raster.spread(top), keys, "left").select(*keys, "r", "c", (F.col("label") + F.coalesce("top", F.lit(0))).alias("label"))
        return keep(merged_regions(rooms.unionByName(rest), keys, force_below, merge_below, area))
