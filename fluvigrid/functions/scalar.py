"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres between points in degrees, by the spherical law of cosines; equal points are 0 apart."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * EARTH_KM


def vapor_pressure(t: Column, rh: Column) -> Column:
    """kPa from degrees C and relative humidity (0 to 1), by Magnus' formula."""
    return F.exp(17.62 * t / (t + 243.12)) * 611.2 * rh * 0.001


def daily_energy(watts: Column) -> Column:
    """MJ a day and square metre from W/m2."""
    return watts * 86_400 / 1e6


def half_even(v: Column, digits: int = 0) -> Column:
    return F.bround(v, digits)


def substitute(pattern: str, values: dict[str, Column]) -> Column:
    """A text with ``%%name%%`` marks replaced by columns."""
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"%%{name}%%"), value.cast("string"))
    return out


def with_default(v: Column, default: float, zero_too: bool = False) -> Column:
    """Missing values (and zeros, if asked) become the default."""
    return F.coalesce(F.nullif(v, F.lit(0.0)) if zero_too else v, F.lit(default))
