"""Box, grid, map and distance expressions (all JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Study box in degrees, grid cells, map pixels and sphere radii.
LNG_LOW, LNG_HIGH = 121.308, 121.598
LAT_LOW, LAT_HIGH = 31.146, 31.306
MAP_WIDTH, MAP_HEIGHT = 850, 550
GRID_WIDTH, GRID_HEIGHT = 28, 24
CELL_PIXEL_X, CELL_PIXEL_Y, CELL_PIXEL_MARGIN = 30, 23, 10
RADIUS_KM = 6400.0
QUERY_RADIUS_M = 6378100.0


def in_box(lng: Column, lat: Column) -> Column:
    """Strictly inside the study box."""
    return (lng > LNG_LOW) & (lng < LNG_HIGH) & (lat > LAT_LOW) & (lat < LAT_HIGH)


def grid_x(lng: Column) -> Column:
    return ((lng - F.lit(LNG_LOW)) / F.lit(LNG_HIGH - LNG_LOW) * F.lit(float(GRID_WIDTH))).cast("int")


def grid_y(lat: Column) -> Column:
    return ((lat - F.lit(LAT_LOW)) / F.lit(LAT_HIGH - LAT_LOW) * F.lit(float(GRID_HEIGHT))).cast("int")


def cell_name(gx: Column, gy: Column) -> Column:
    return F.concat_ws("_", gx.cast("string"), gy.cast("string"))


def cell_center_lng(gx: Column) -> Column:
    return (gx + F.lit(0.5)) / F.lit(float(GRID_WIDTH)) * F.lit(LNG_HIGH - LNG_LOW) + F.lit(LNG_LOW)


def cell_center_lat(gy: Column) -> Column:
    return (gy + F.lit(0.5)) / F.lit(float(GRID_HEIGHT)) * F.lit(LAT_HIGH - LAT_LOW) + F.lit(LAT_LOW)


def pixel_x(lng: Column) -> Column:
    return ((lng - F.lit(LNG_LOW)) / F.lit(LNG_HIGH - LNG_LOW) * F.lit(float(MAP_WIDTH))).cast("int")


def pixel_y(lat: Column) -> Column:
    """Image rows grow downwards, so the latitude axis is flipped."""
    return ((F.lit(LAT_HIGH) - lat) / F.lit(LAT_HIGH - LAT_LOW) * F.lit(float(MAP_HEIGHT))).cast("int")


def pixel_lng(x: Column) -> Column:
    return x.cast("double") / F.lit(float(MAP_WIDTH)) * F.lit(LNG_HIGH - LNG_LOW) + F.lit(LNG_LOW)


def pixel_lat(y: Column) -> Column:
    """True inverse of :func:`pixel_y`."""
    return F.lit(LAT_HIGH) - y.cast("double") / F.lit(float(MAP_HEIGHT)) * F.lit(LAT_HIGH - LAT_LOW)


def cell_pixel_x(gx: Column) -> Column:
    return gx * CELL_PIXEL_X + CELL_PIXEL_MARGIN


def cell_pixel_y(gy: Column) -> Column:
    return (F.lit(GRID_HEIGHT - 1) - gy) * CELL_PIXEL_Y


def distance_compat(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Distance in km to two decimals with the longitude in the role of the polar angle."""
    a1, a2 = F.radians(lng1), F.radians(lng2)
    turn = F.cos(F.radians(lat1) - F.radians(lat2))
    cosine = F.sin(a1) * F.sin(a2) * turn + F.cos(a1) * F.cos(a2)
    return F.round(F.lit(RADIUS_KM) * F.acos(_at_most_one(cosine)), 2)


def _at_most_one(value: Column) -> Column:
    """Clamp from above; unlike a least-of, NULL stays NULL."""
    return F.when(value > 1.0, F.lit(1.0)).otherwise(value)


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = RADIUS_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2.0 * radius) * F.asin(_at_most_one(F.sqrt(chord)))
