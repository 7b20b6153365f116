"""Coordinate systems in closed form: polar stereographic on a sphere (km) and spherical web Mercator (m)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the radar projection: sphere radius in km, true latitude and central meridian in degrees.
RADIUS_KM, TRUE_LATITUDE, MERIDIAN = 6370.04, 60.0, 10.0
_SCALE = 1 + math.sin(math.radians(TRUE_LATITUDE))
WEB_RADIUS_M = 6378137.0


def to_stereographic(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    r = F.cos(phi) * (RADIUS_KM * _SCALE) / (1 + F.sin(phi))
    return r * F.sin(lam), -r * F.cos(lam)


def from_stereographic(x: Column, y: Column) -> tuple[Column, Column]:
    lon = F.degrees(F.atan2(x, -y)) + MERIDIAN
    lat = 90 - 2 * F.degrees(F.atan(F.sqrt(x * x + y * y) / (RADIUS_KM * _SCALE)))
    return lon, lat


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * WEB_RADIUS_M, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * WEB_RADIUS_M


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WEB_RADIUS_M), F.degrees(2 * F.atan(F.exp(y / WEB_RADIUS_M)) - math.pi / 2)


def buffered(box: tuple[float, float, float, float], by: float = 50.0) -> tuple[float, float, float, float]:
    """A box (xmin, xmax, ymin, ymax) grown on all sides."""
    return box[0] - by, box[1] + by, box[2] - by, box[3] + by
