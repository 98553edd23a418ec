"""A map camera against boxes: altitude, ground position, distances, angular size, what lies behind."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_CIRCUMFERENCE = 40075016.68557849
DEFAULT_FOV_DEGREES = 36.87
DEFAULT_VIEWPORT = 900
MIN_COS_PITCH, MIN_COS_LAT = 0.28, 0.01
INFINITY = float("inf")


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT)) * EARTH_CIRCUMFERENCE / (F.pow(F.lit(2.0), zoom) * 512)


def fov_radians(fov: Column) -> Column:
    """Values above pi are degrees; absent ones are the default."""
    given = F.when(fov > math.pi, F.radians(fov)).otherwise(fov.cast("double"))
    return F.when((fov > 0) & (fov < INFINITY), given).otherwise(F.lit(math.radians(DEFAULT_FOV_DEGREES)))


def altitude(lat: Column, zoom: Column, pitch: Column, viewport: Column, fov: Column) -> Column:
    height = F.greatest(F.coalesce(F.nullif(viewport, F.lit(0)), F.lit(DEFAULT_VIEWPORT)), F.lit(1))
    return metres_per_pixel(lat, zoom) * height * F.greatest(F.cos(F.radians(pitch)), F.lit(MIN_COS_PITCH)) / (F.tan(fov_radians(fov) / 2) * 2)


def ground_position(center_x: Column, center_y: Column, z: Column, pitch: Column, bearing: Column) -> Column:
    """struct<x, y, z>: behind the map centre by z tan(pitch), against the bearing."""
    back = F.when(z > 0, F.greatest(z * F.tan(F.radians(pitch)), F.lit(0.0))).otherwise(0.0)
    return F.struct(
        (center_x - F.sin(F.radians(bearing)) * back).alias("x"), (center_y - F.cos(F.radians(bearing)) * back).alias("y"), z.alias("z")
    )


def outside(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies outside an interval."""
    return F.greatest(low - value, value - high, F.lit(0.0))


def length(*sides: Column) -> Column:
    total = sides[0] * sides[0]
    for s in sides[1:]:
        total = total + s * s
    return F.sqrt(total)


def vertical_bounds(bounds: Column, min_z: Column, max_z: Column) -> tuple[Column, Column]:
    """A box's own heights where it has them, else those of its points, else 0."""
    low = F.coalesce(bounds["min_z"], min_z, F.lit(0.0))
    high = F.coalesce(bounds["max_z"], max_z, low)
    return F.least(low, high), F.greatest(low, high)


def diagonal(bounds: Column, min_z: Column, max_z: Column) -> Column:
    low, high = vertical_bounds(bounds, min_z, max_z)
    return length(bounds["max_x"] - bounds["min_x"], bounds["max_y"] - bounds["min_y"], high - low)


def distance(camera: Column, bounds: Column, min_z: Column, max_z: Column) -> Column:
    """Metres from a camera (struct x, y, z) to a box; infinite without a camera."""
    low, high = vertical_bounds(bounds, min_z, max_z)
    across = length(outside(camera["x"], bounds["min_x"], bounds["max_x"]), outside(camera["y"], bounds["min_y"], bounds["max_y"]))
    return F.coalesce(length(across, outside(F.coalesce(camera["z"], F.lit(0.0)), low, high)), F.lit(INFINITY))


def angular_size(diagonal: Column, distance: Column) -> Column:
    """Degrees that a box takes up: infinite inside it, 0 for boxes without extent and distances without end."""
    flat = ~((diagonal > 0) & (diagonal < INFINITY))
    far = ~((distance > 0) & (distance < INFINITY))
    half = F.atan(diagonal / (F.when(~far, distance).otherwise(1.0) * 2))
    return F.when(flat, 0.0).when(distance == 0, INFINITY).when(far, 0.0).otherwise(F.degrees(half * 2))


def behind(bounds: Column, x: Column, y: Column, forward_x: Column, forward_y: Column) -> Column:
    """Whether no corner of a box lies ahead; false where the direction is unknown or has no length."""
    corners = [(cx - x) * forward_x + (cy - y) * forward_y for cx in (bounds["min_x"], bounds["max_x"]) for cy in (bounds["min_y"], bounds["max_y"])]
    return F.coalesce((F.greatest(*corners) <= 0) & ((forward_x != 0) | (forward_y != 0)), F.lit(False))


def zoom_for_altitude(lat: Column, altitude_m: Column, pitch: Column, viewport: int = DEFAULT_VIEWPORT) -> Column:
    visible = F.greatest(altitude_m, F.lit(1.0)) * 2 * math.tan(math.radians(DEFAULT_FOV_DEGREES) / 2) / F.greatest(F.cos(F.radians(pitch)), F.lit(MIN_COS_PITCH))
    around = F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT)) * EARTH_CIRCUMFERENCE
    return F.least(F.greatest(F.log2(around / (visible / viewport * 512)), F.lit(8.0)), F.lit(18.0))
