"""Composed queries: what an application asks for."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube, graph, stations, temporal, zonal
from ..sources.catalog import FULL_HORIZON, FULL_HORIZON_HOUR, SHORT_HORIZON, Product
from ..streaming import ingest


def basin_series(data: DataFrame, overlap: DataFrame, links: DataFrame, outlet: DataFrame, t: tuple[int, int] | None = None) -> DataFrame:
    """Areal statistics per step of everything upstream of one outlet: upstream ids, dissolved overlap, one aggregation."""
    ids = graph.upstream(links, outlet).select(F.col("id"), F.lit(0).alias("group"))
    basin = zonal.dissolve(overlap, ids)
    return cube.finite(cube.mask_statistics(cube.subset(data, t=t), basin))


def forecast_series(runs: DataFrame, requests: DataFrame, full: Column, short_steps: int, full_steps: int) -> DataFrame:
    """Valid times and values of the newest run before each request."""
    chosen = temporal.latest_run(runs, requests, full, short_steps, full_steps)
    return chosen.select("id", (F.col("run") + F.col("f") * 3600).alias("t"), "v")


def flood_features(discharge: DataFrame, rain: DataFrame, forecast: DataFrame) -> DataFrame:
    """Comma-joined discharge (hourly, right-closed) and spliced precipitation series, one row: the input of a flood model."""
    q = temporal.hourly_mean(discharge, ()).select(F.col("hour").alias("t"), "v").withColumn("kind", F.lit("q"))
    p = temporal.splice(rain, forecast).withColumn("kind", F.lit("p"))
    return temporal.comma_series(q.unionByName(p), ("kind",))


def station_forcing(places: DataFrame, station_table: DataFrame, measurements: DataFrame, k: int = 10) -> DataFrame:
    """Daily forcing per place: the first radius with stations, the k nearest, inverse-distance means."""
    near = stations.tiered(places, station_table)
    return stations.inverse_distance(stations.daily(measurements), stations.nearest(near, k))


def catchment_ids(requests: DataFrame, polys: DataFrame, station_catchments: DataFrame, strict: bool = True) -> DataFrame:
    """``pid, id`` of requests (pid, station, x, y): the smallest catchment id of the station where one is named, else
    the catchment at the point. No catchment is an error when the row is read, or a null id if not ``strict``."""
    mapped = station_catchments.groupBy("station").agg(F.min("id").alias("by_station"))
    located = zonal.locate(requests.where("station is null").select("pid", "x", "y"), polys).select("pid", F.col("id").alias("by_point"))
    found = requests.join(mapped, "station", "left").join(located, "pid", "left").select("pid", F.coalesce("by_station", "by_point").alias("id"))
    missed = F.raise_error(F.concat(F.lit("no catchment for request "), F.col("pid").cast("string"))).cast(found.schema["id"].dataType)
    return found.select("pid", F.when(F.col("id").isNull(), missed).otherwise(F.col("id")).alias("id")) if strict else found


def catchments_upstream(catchments: DataFrame, links: DataFrame, starts: DataFrame, merge: bool = False) -> DataFrame:
    """All catchments (id, area_sqkm, rings) above each start (id), with column ``start``; with ``merge`` a row for each
    start: ``id, n, area_sqkm, rings``, its outline."""
    above = graph.upstream(links, starts).select("start", "id")
    if not merge:
        return above.join(catchments, "id")
    sums = above.join(catchments.select("id", "area_sqkm"), "id").groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("area_sqkm").alias("area_sqkm"))
    return sums.join(zonal.merged_outline(catchments.select("id", "rings"), above.select("id", F.col("start").alias("group"))), "id")


def _seconds(t: datetime) -> int:
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def radar_series(spark: SparkSession, path: str, start: datetime, end: datetime, stats: bool = True, **where: object) -> DataFrame:
    """A stored cube's series from start to end, over as many years as they span: ``where`` is a box or an overlap.
    A range that the cube has nothing of is an error, as is one that ends before it starts."""
    if end < start:
        raise ValueError("the range ends before it starts")
    t = _seconds(start), _seconds(end)
    data = cube.read_cube(spark, path, t)
    if not data.limit(1).count():
        raise LookupError(f"there is nothing between {start} and {end}")
    return cube.request(data, t=t, stats=stats, **where)


def discharge(known: DataFrame, station: str, start: datetime, end: datetime, services: dict[str, Callable[[str, datetime, datetime], DataFrame]], service: str) -> DataFrame:
    """A station's discharge from one of several services; a station that is not among the ``known`` is an error."""
    if not known.where(F.col("station") == station).limit(1).count():
        raise LookupError(f"station {station} is not available")
    if service not in services:
        raise ValueError(f"unknown service {service!r}; there are {', '.join(services)}")
    return services[service](station, start, end)


def update_radar_year(folder: str, product: Product, arrived: DataFrame, now: datetime) -> int:
    """The job of the running year: what has arrived of it up to the newest step there can be, into the product's table.
    Running it again adds nothing. Returns the rows written."""
    first, _ = product.steps(now.year)
    steps = arrived.where(F.col("t").between(_seconds(first), _seconds(product.latest(now))))
    return ingest.update(f"{folder.rstrip('/')}/{product.name}", steps)


def update_forecast_year(folder: str, product: Product, arrived: DataFrame, now: datetime, append_only: bool = False) -> None:
    """The same for forecasts (run, f, ix, iy, v): complete runs of the running year that the product's table lacks, as
    step values if the product holds running totals. A run whose write was cut off is completed the next time."""
    spark, target = arrived.sparkSession, f"{folder.rstrip('/')}/{product.name}"
    last = F.when(F.hour(F.timestamp_seconds("run")) == FULL_HORIZON_HOUR, FULL_HORIZON).otherwise(SHORT_HORIZON)
    there = ingest.existing(spark, target, "run bigint, f int, ix int, iy int, v double, year int")
    of_year = arrived.where(F.col("run").between(_seconds(datetime(now.year, 1, 1)), _seconds(now)))
    count = there.groupBy("run").agg(F.countDistinct("f").alias("n"))
    whole = there.join(count.where(F.col("n") == last + 1), "run", "left_semi")
    new = ingest.forecast_update(of_year, whole, last + 1, product.is_sum, append_only)
    rows = new.select("run", "f", "ix", "iy", "v").join(there.select("run", "f", "ix", "iy"), ["run", "f", "ix", "iy"], "left_anti")
    rows.withColumn("year", F.year(F.timestamp_seconds("run"))).write.partitionBy("year").mode("append").parquet(target)
