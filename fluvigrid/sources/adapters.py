"""The star-schema tables seen as cubes, forecasts, stations, polygons, rivers and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(value: F.Column) -> F.Column:
    """Sums of two-decimal values, whatever their order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def epoch(ts: F.Column) -> F.Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def cube(spark: SparkSession, sf_dir: str, step: int = 86_400) -> DataFrame:
    """``t, ix, iy, v`` on a 16 x 16 grid; every seventh event is a flagged one, so some cells have no data."""
    events = table(spark, sf_dir, "events")
    keyed = events.select(
        (F.floor(epoch(F.col("ts")) / step) * step).cast("long").alias("t"),
        (F.col("event_id") % SIDE).cast("int").alias("ix"),
        (F.floor(F.col("event_id") / SIDE) % SIDE).cast("int").alias("iy"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )
    return keyed.groupBy("t", "ix", "iy").agg(exact_sum(F.col("value")).alias("v"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, f, v``: runs are order dates (seconds), steps line numbers."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = joined.select(epoch(F.col("o_orderdate")).alias("run"), F.col("l_linenumber").alias("f"), "l_quantity")
    return keyed.groupBy("run", "f").agg(exact_sum(F.col("l_quantity")).alias("v"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("station"), (F.lit(11.0) + (k * 37 % 500) / 100).alias("lon"), (F.lit(50.0) + (k * 61 % 200) / 100).alias("lat"), (F.col("s_acctbal") / 10).alias("height")
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), F.col("event_type").alias("phenomenon"), "ts", F.col("value").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = F.lit(0.25) + (n % 5) * 3.1, F.lit(0.5) + F.floor(n / 5) * 3.1
    return table(spark, sf_dir, "nation").select(n.alias("id"), x.alias("xmin"), (x + 2.6).alias("xmax"), y.alias("ymin"), (y + 2.6).alias("ymax"))


def catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, next, area_sqkm``: catchment k drains into k div 2, catchment 0 out of the region (-1)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k == 0, -1).otherwise(F.floor(k / 2)).cast("long").alias("next"), (F.col("p_retailprice") / 100).alias("area_sqkm"))


#: The types of events, in order (fixed values of the events table).
KINDS = ("click", "error", "purchase", "signup", "view")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date`` and daily temperatures, radiation, humidity, wind and precipitation, scaled to physical ranges."""
    events = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    pick = lambda i: KINDS[i]
    return events.groupBy("date").agg(
        (F.min("value") / 50 - 4).alias("tmin"), (F.max("value") / 40 + 2).alias("tmax"), (mean(pick(0)) / 2).alias("radiation"),
        F.least(F.lit(1.0), mean(pick(1)) / 180).alias("rh"), (mean(pick(2)) / 40).alias("wind"), (F.greatest(F.lit(0.0), mean(pick(3)) - 100) / 8).alias("precip"),
    )
