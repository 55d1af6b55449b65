"""Coordinates: world and grid, voxels, pinhole cameras, rigid transforms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MapFrame:
    """A grid over the world: rows grow as y falls."""

    resolution: float
    min_x: float
    max_y: float
    width: int
    height: int
    z_min: float = 0.0
    z_resolution: float = 0.05
    z_bins: int = 1


def row_of(y: Column, frame: MapFrame) -> Column:
    return F.floor((F.lit(frame.max_y) - y) / frame.resolution)


def col_of(x: Column, frame: MapFrame) -> Column:
    return F.floor((x - frame.min_x) / frame.resolution)


def x_of(col: Column, frame: MapFrame) -> Column:
    return frame.min_x + (col + 0.5) * frame.resolution


def y_of(row: Column, frame: MapFrame) -> Column:
    return frame.max_y - (row + 0.5) * frame.resolution


def inside(row: Column, col: Column, frame: MapFrame) -> Column:
    return row.between(0, frame.height - 1) & col.between(0, frame.width - 1)


def clamped(value: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), value))


def voxel_place(x: Column, y: Column, z: Column, frame: MapFrame) -> dict[str, Column]:
    """Fractional voxel coordinates."""
    return {"z": (z - frame.z_min) / frame.z_resolution, "r": (F.lit(frame.max_y) - y) / frame.resolution, "c": (x - frame.min_x) / frame.resolution}


def z_bin(height: Column, frame: MapFrame) -> Column:
    """The bin of a height, null outside."""
    k = F.floor((height - frame.z_min) / frame.z_resolution)
    return F.when(k.between(0, frame.z_bins - 1), k)


def z_centre(k: Column, frame: MapFrame) -> Column:
    return frame.z_min + (k + 0.5) * frame.z_resolution


def z_between(k: Column, low_m: float, high_m: float, frame: MapFrame) -> Column:
    """Whether a bin's centre lies in a range of heights."""
    return z_centre(k, frame).between(low_m, high_m)


def active_z_top(ceiling: Column, ratio: float, fallback: float, cap: float) -> Column:
    """Highest active height: a ratio of the ceiling where it is known, never over the cap."""
    return F.least(F.coalesce(ceiling * ratio, F.lit(fallback)), F.lit(cap))


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float

    @staticmethod
    def of_view(width: int, height: int, hfov_deg: float) -> Camera:
        f = width / (2 * math.tan(math.radians(hfov_deg) / 2))
        return Camera(f, f, (width - 1) / 2, (height - 1) / 2)


def plane_depth(range_m: Column, u: Column, v: Column, camera: Camera) -> Column:
    """Depth along the axis from the distance to the camera."""
    return range_m / F.sqrt(1 + F.pow((u - camera.cx) / camera.fx, 2) + F.pow((v - camera.cy) / camera.fy, 2))


def backprojected(u: Column, v: Column, depth: Column, camera: Camera) -> dict[str, Column]:
    """Camera coordinates of a pixel: x to the right, y down, z ahead."""
    return {"cam_x": (u - camera.cx) * depth / camera.fx, "cam_y": (v - camera.cy) * depth / camera.fy, "cam_z": depth}


def to_world(x: Column, y: Column, z: Column, pose_x: Column, pose_y: Column, pose_z: Column, yaw: Column) -> dict[str, Column]:
    """Points of a level camera (x right, y down, z ahead) in the world, yaw about the vertical."""
    ahead, left = z, -x
    return {"x": pose_x + ahead * F.cos(yaw) - left * F.sin(yaw), "y": pose_y + ahead * F.sin(yaw) + left * F.cos(yaw), "z": pose_z - y}


def transformed(x: Column, y: Column, z: Column, matrix: Column) -> dict[str, Column]:
    """Points by a 4x4 matrix given as an array of 16, row by row."""
    row = lambda i: F.get(matrix, 4 * i) * x + F.get(matrix, 4 * i + 1) * y + F.get(matrix, 4 * i + 2) * z + F.get(matrix, 4 * i + 3)
    return {"x": row(0), "y": row(1), "z": row(2)}


def hit_class(depth: Column, least: float, most: float, eps: float = 1e-3, free_on_nan: bool = False, free_on_zero: bool = False) -> Column:
    """hit, free_only or bad for a depth reading."""
    beyond = (depth >= most - eps) & ~F.isnan(depth)
    extra = (F.isnan(depth) if free_on_nan else F.lit(False)) | ((depth == 0) if free_on_zero else F.lit(False))
    return F.when((depth > least) & (depth < most - eps), "hit").when(beyond | extra, "free_only").otherwise("bad")


def touches_edge(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, margin: float) -> Column:
    return (x0 <= margin) | (y0 <= margin) | (x1 >= width - 1 - margin) | (y1 >= height - 1 - margin)
