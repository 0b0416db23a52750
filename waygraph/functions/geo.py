"""Distances, bearings and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean earth radius in metres.
EARTH_RADIUS = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane that touches at the mean latitude; good for short distances."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return EARTH_RADIUS * F.sqrt(x * x + y * y)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def straight_line(space: str, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The metric of a coordinate space: `planar`, or `geographic` with x = lon and y = lat."""
    return haversine(y1, x1, y2, x2) if space == "geographic" else euclidean(x1, y1, x2, y2)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees clockwise from north, in [0, 360)."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(
        F.radians(lon2 - lon1)
    )
    d = F.degrees(F.atan2(y, x))
    return F.when(d < 0, d + 360).otherwise(d)


def planar_bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from the y axis, in [0, 360)."""
    d = F.degrees(F.atan2(x2 - x1, y2 - y1))
    return F.when(d < 0, d + 360).otherwise(d)


def turn_angle(before: Column, after: Column) -> Column:
    """Signed change of bearing in (-180, 180]."""
    d = after - before
    return d - 360 * F.ceil((d - 180) / 360)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator, normalised to [0, 1], y downwards."""
    s = F.sin(F.radians(lat))
    return (lon + 180) / 360, 0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a normalised Web Mercator point."""
    n = math.pi * (1 - 2 * y)
    return F.degrees(F.atan((F.exp(n) - F.exp(-n)) / 2)), x * 360 - 180
