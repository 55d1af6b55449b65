"""Scalar column functions: scores, geometry, strings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF = float("inf")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def distance(dx: Column, dy: Column) -> Column:
    """The root of the sum of squares, as SQL writes it; hypot rounds otherwise in the last bit."""
    x, y = dx.cast("double"), dy.cast("double")
    return F.sqrt(x * x + y * y)


@F.pandas_udf(DoubleType())
def _c_pow(x: pd.Series, y: pd.Series) -> pd.Series:
    def one(a: float, b: float) -> float:
        try:
            return math.pow(a, b)
        except (OverflowError, ValueError):
            return float(np.float_power(a, b))

    return pd.Series([one(a, b) for a, b in zip(x, y)], dtype="float64")


def c_pow(x: Column, exponent: float) -> Column:
    """The C library's pow, which SQL calls: it may miss the last bit of a square that takes over 53 bits, where Spark's does not."""
    return F.when(F.isnan(x), x).otherwise(_c_pow(x.cast("double"), F.lit(float(exponent))))


def spl(success: Column, shortest: Column, path: Column) -> Column:
    """Success weighted by path length; 0 without success or a finite shortest distance."""
    return F.when(success & finite(shortest), shortest / F.greatest(path, shortest, F.lit(1e-6))).otherwise(0.0)


def soft_spl(first: Column, last: Column, shortest: Column, path: Column) -> Column:
    """The same with progress towards the goal in place of success."""
    started = finite(first) & (first > 1e-6)
    progress = F.when(started, F.greatest(F.lit(0.0), 1 - last / F.greatest(first, F.lit(1e-6)))).when(last <= 1e-6, 1.0).otherwise(0.0)
    return F.when(finite(shortest), progress * shortest / F.greatest(path, shortest, F.lit(1e-6))).otherwise(0.0)


def under_segmentation(truth: Column, found: Column) -> Column:
    return F.greatest(truth - found, F.lit(0)) / F.greatest(truth, F.lit(1))


def over_segmentation(truth: Column, found: Column) -> Column:
    return F.greatest(found - truth, F.lit(0)) / F.greatest(truth, F.lit(1))


def min_area_cells(area_m2: float, cell_m: float) -> int:
    """Cells that an area needs: the ceiling, with room for rounding."""
    if area_m2 <= 0:
        return 0
    if cell_m <= 0:
        raise ValueError("cells need a positive size")
    return math.ceil(area_m2 / max(cell_m**2, 1e-12) - 1e-9)


def inverse_distance(distance: Column, least_m: float, span_m: float) -> Column:
    """1 at the least distance, falling to 0 over the span, clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (distance - least_m) / max(span_m, 1e-9)))


def clearance_penalty(clearance: Column, desired: float, hard_least: float, weight: float, power: float) -> Column:
    """weight * (deficit / desired) ** power; infinite under the hard minimum."""
    deficit = F.greatest(F.lit(0.0), F.lit(desired) - clearance) / max(desired, 1e-9)
    return F.when(clearance < hard_least, F.lit(INF)).otherwise(weight * c_pow(deficit, power))


def line_angle_deg(ar: Column, ac: Column, br: Column, bc: Column) -> Column:
    """The angle between two undirected lines, 0 to 90 degrees; null for a zero vector."""
    size = distance(ar, ac) * distance(br, bc)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(ar * br + ac * bc) / F.nullif(size, F.lit(0.0)))))


def nearest_axis(dr: Column, dc: Column) -> Column:
    return F.when(F.abs(dc) >= F.abs(dr), "horizontal").otherwise("vertical")


def polygon_area(points: Column, x: str = "x", y: str = "y") -> Column:
    """Shoelace area of an array of points; 0 under three."""
    n = F.size(points)
    term = lambda p, i: p[x] * F.get(points, (i + 1) % n)[y] - F.get(points, (i + 1) % n)[x] * p[y]
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.transform(points, term), F.lit(0.0), lambda a, b: a + b)) / 2)


def point_in_polygon(px: Column, py: Column, points: Column, x: str = "x", y: str = "y") -> Column:
    """Crossing parity of a ray in the direction of x over the polygon's edges."""
    n = F.size(points)

    def crosses(p, i):
        q = F.get(points, (i + 1) % n)
        straddles = (p[y] > py) != (q[y] > py)
        at = (q[x] - p[x]) * (py - p[y]) / F.nullif(q[y] - p[y], F.lit(0.0)) + p[x]
        return F.when(straddles & (px < at), 1).otherwise(0)

    return (n >= 3) & (F.aggregate(F.transform(points, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1)


def point_box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    zero = F.lit(0.0)
    return F.sqrt(c_pow(F.greatest(x0 - x, x - x1, zero), 2) + c_pow(F.greatest(y0 - y, y - y1, zero), 2))


def box_iou_3d(a: Column, b: Column) -> Column:
    """IoU of two boxes given as arrays (x0, y0, z0, x1, y1, z1); 0 for an empty union."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(F.get(a, i + 3), F.get(b, i + 3)) - F.greatest(F.get(a, i), F.get(b, i)))
    volume = lambda v: (F.get(v, 3) - F.get(v, 0)) * (F.get(v, 4) - F.get(v, 1)) * (F.get(v, 5) - F.get(v, 2))
    inter = side(0) * side(1) * side(2)
    union = volume(a) + volume(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def entropy(weights: Column) -> Column:
    """Natural-log entropy of the positive values of a map."""
    values = F.filter(F.map_values(weights), lambda v: v > 0)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a - v / total * F.ln(v / total))).otherwise(0.0)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[^A-Za-z0-9_.-]+", "_")


def normal_category(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, separators as one space, no instance suffix, aliases resolved."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[_\-\s]+", " "), r"\s+\d+$", ""))
    if not aliases:
        return plain
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), plain), plain)


def without_instance(text: Column) -> Column:
    return F.regexp_replace(text, r"[_\-\s]+\d+$", "")


def truth_of(text: Column) -> Column:
    """Boolean of usual spellings; null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "yes", "y", "on", "t"), True).when(low.isin("0", "false", "no", "n", "off", "f", ""), False)


def step_of_path(path: Column, pattern: str = r"step_(\d+)") -> Column:
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found.cast("long"))


def step_with_source(path: Column, summary: Column, metadata: Column) -> Column:
    """(step, where it came from): the file's name, else the summary, else the metadata."""
    named = step_of_path(path)
    source = F.when(named.isNotNull(), "filename").when(summary.isNotNull(), "summary").when(metadata.isNotNull(), "metadata").otherwise("missing")
    return F.struct(F.coalesce(named, summary, metadata).alias("step"), source.alias("source"))


def json_object(text: Column) -> Column:
    """The first JSON object inside free text, as a string, or null where none parses."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def json_int(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}").cast("long")


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
