"""Stations: nearest ones with ties, growing radii, inverse-distance weighting, area-weighted averages, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_KM, great_circle

TIERS_KM = (50.0, 200.0, 1000.0)


def distances(places: DataFrame, stations: DataFrame, radius_km: float, max_height: float | None = None) -> DataFrame:
    """Stations within a radius of each place (id, lon, lat[, height]), with ``dist`` in km.

    Both sides meet on cells: bands of latitude as high as the radius, cut into cells of longitude that are as wide as
    the radius is anywhere in the band or next to it. A place looks into its own cell and those around it, across the
    date line too, so there is no product of the tables.
    """
    high, half = radius_km / 111.0, math.sin(min(radius_km / EARTH_KM, math.pi) / 2)

    def ring(band: Column) -> Column:
        """Number of cells around the earth: places within the radius are at most one cell apart."""
        farthest = F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * high)
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(half) / F.cos(F.radians(farthest))))) * 2
        return F.floor(F.lit(360.0) / (wide * 1.000001))

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n), n)

    around = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: c + k))
    asked = places.withColumnsRenamed({"lon": "p_lon", "lat": "p_lat", "height": "p_height"}).withColumn("band", around(F.floor(F.col("p_lat") / high)))
    n = ring(F.col("band"))
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(cell(F.col("p_lon"), n) + k, n))
    asked = asked.withColumn("cell", F.explode(F.array_distinct(beside)))
    placed = stations.withColumn("band", F.floor(F.col("lat") / high)).withColumn("cell", cell(F.col("lon"), n))
    near = placed.join(asked, ["band", "cell"]).drop("band", "cell")
    near = near.withColumn("dist", great_circle(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat"))).where(F.col("dist") <= radius_km)
    if max_height is not None:
        near = near.where(F.abs(F.col("height") - F.col("p_height")) <= max_height)
    return near


def tiered(places: DataFrame, stations: DataFrame, tiers: tuple[float, ...] = TIERS_KM, max_height: float | None = None) -> DataFrame:
    """Stations within the first radius that has any, and its ``tier`` from 1: the larger radii are searched only for
    the places that the smaller ones left without a station. Ids of places are keys."""
    found, left = None, places
    for k, km in enumerate(tiers, 1):
        near = distances(left, stations, km, max_height).withColumn("tier", F.lit(k))
        left = left.join(near.select("id").distinct(), "id", "left_anti")
        found = near if found is None else found.unionByName(near)
    return found


def nearest(near: DataFrame, k: int, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k nearest of each place; those as far as the k-th stay."""
    order = Window.partitionBy(*by).orderBy("dist")
    return near.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k)


def first_tier(near: DataFrame, tiers: tuple[float, ...] = TIERS_KM, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Stations within the first radius that has any; ``tier`` from 1."""
    tier = F.lit(None).cast("int")
    for k, km in reversed(list(enumerate(tiers, 1))):
        tier = F.when(F.col("dist") <= km, k).otherwise(tier)
    out = near.withColumn("tier", tier).where("tier is not null")
    return out.withColumn("_least", F.min("tier").over(Window.partitionBy(*by))).where("tier = _least").drop("_least")


def fresh(near: DataFrame, measurements: DataFrame, since: Column) -> DataFrame:
    """Only stations with a measurement at or after ``since``."""
    newest = measurements.groupBy("station").agg(F.max("ts").alias("newest"))
    return near.join(newest.where(F.col("newest") >= since).select("station"), "station", "left_semi")


def freshness(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("station", "phenomenon").agg(F.max("ts").alias("max_time"), F.count(F.lit(1)).alias("n"))


def daily(measurements: DataFrame, by: tuple[str, ...] = ("station",)) -> DataFrame:
    return measurements.groupBy(*by, F.to_date("ts").alias("date")).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))


def inverse_distance(series: DataFrame, near: DataFrame, power: float = 2.0) -> DataFrame:
    """Per place and date: mean weighted by 1 / dist^power over stations with a value; max and min are plain means."""
    w = 1 / F.pow(F.greatest(F.col("dist"), F.lit(1e-9)), F.lit(power))
    joined = series.join(near.select("id", "station", "dist"), "station").withColumn("w", w)
    mean = F.try_divide(F.sum(F.col("mean") * F.col("w")), F.sum(F.when(F.col("mean").isNotNull(), F.col("w"))))
    return joined.groupBy("id", "date").agg(mean.alias("mean"), F.avg("max").alias("max"), F.avg("min").alias("min"))


def area_weighted(values: DataFrame, by: tuple[str, ...], value: str = "v", area: str = "area") -> DataFrame:
    """Average weighted by area; one missing value makes it null."""
    whole = F.count(value) == F.count(F.lit(1))
    return values.groupBy(*by).agg(F.when(whole, F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(area))).alias("avg"))


def coverage_gate(parts: DataFrame, covered: Column, warn: float = 0.25, fail: float = 0.5) -> DataFrame:
    """Per id the share of area that is not covered, and ok, warn or error."""
    share = F.coalesce(F.try_divide(F.sum(F.when(~covered, F.col("area")).otherwise(0.0)), F.sum("area")), F.lit(1.0))
    out = parts.groupBy("id").agg(share.alias("missing"))
    return out.withColumn("status", F.when(F.col("missing") > fail, "error").when(F.col("missing") > warn, "warn").otherwise("ok"))


def deduplicate(measurements: DataFrame, keys: tuple[str, ...] = ("station", "ts")) -> DataFrame:
    """One row per key: the smallest value, so that reruns agree."""
    return measurements.groupBy(*keys).agg(F.min("v").alias("v"))


def daily_sum(measurements: DataFrame, by: tuple[str, ...] = ("station",)) -> DataFrame:
    """Daily totals, for precipitation; days without a value have none."""
    return measurements.groupBy(*by, F.to_date("ts").alias("date")).agg(F.sum("v").alias("sum"))
