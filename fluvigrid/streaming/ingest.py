"""Incremental ingestion: only missing steps, complete runs only, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.temporal import complete_runs, deaccumulate, missing_steps


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The target table, or an empty one where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def update(target: str, arrived: DataFrame, keys: tuple[str, ...] = ("t", "ix", "iy"), partition: str = "day", append_only: bool = False) -> int:
    """Append the cells of ``arrived`` that the target lacks; running it again appends nothing. Returns the rows written.

    A step may arrive in several parts, or anew after a write that was cut off: rows are compared by all ``keys``.
    Late steps fill gaps; with ``append_only`` steps before the newest one are left out. Of rows with equal keys in
    one arrival the smallest value is kept. Only the target's partitions that the arrival touches are read.
    """
    spark = arrived.sparkSession
    there = existing(spark, target, arrived.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + f", {partition} date")
    first, last = arrived.agg(F.min("t"), F.max("t")).first()
    if first is None:
        return 0
    cells = arrived.groupBy(*keys).agg(F.min("v").alias("v"))
    if append_only and (newest := there.agg(F.max("t")).first()[0]) is not None:
        cells = cells.where(F.col("t") >= newest)
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
    known = there.where(F.col(partition).between(day(first), day(last))).select(*keys)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    fresh = cells.alias("a").join(known.alias("b"), reduce(and_, same), "left_anti")
    rows = fresh.select(*arrived.columns).withColumn(partition, F.to_date(F.timestamp_seconds("t"))).persist()
    count = rows.count()
    if count:
        rows.write.partitionBy(partition).mode("append").parquet(target)
    rows.unpersist()
    return count


def stream_update(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, **options: object) -> StreamingQuery:
    """Everything that has arrived in ``source`` and was not read yet, into ``target``; ends when it has caught up.

    Files are tracked by the checkpoint; a batch that is replayed after a failure writes nothing twice, as its steps
    are then there.
    """
    incoming = spark.readStream.schema(schema).parquet(source)
    writer = incoming.writeStream.foreachBatch(lambda df, _: update(target, prepare(df), **options) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_stream(measurements: DataFrame, keys: tuple[str, ...] = ("station", "ts"), late: str = "9 days") -> DataFrame:
    """A measurement stream without repeats, for arrivals at most ``late`` behind."""
    return measurements.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def hourly_stream(measurements: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """Hourly means of a stream, emitted once an hour is final. ``late`` is None where the stream has a watermark."""
    marked = measurements.withWatermark("ts", late) if late else measurements
    buckets = marked.groupBy("station", F.window("ts", "1 hour"))
    return buckets.agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).select("station", F.col("window.end").alias("hour"), "v", "n")


def forecast_update(runs: DataFrame, there: DataFrame, expected: Column, is_sum: bool = True, append_only: bool = False) -> DataFrame:
    """New runs (run, ix, iy, f, v) that are complete, as step values if the product holds running totals."""
    known = there.select(F.col("run").alias("t")).distinct()
    new = missing_steps(runs.select(F.col("run").alias("t")).distinct(), known, append_only=append_only).withColumnRenamed("t", "run")
    whole = complete_runs(runs.join(new, "run", "left_semi"), expected).select("run")
    out = runs.join(whole, "run", "left_semi")
    return deaccumulate(out, ("run", "ix", "iy")).drop("v").withColumnRenamed("step", "v") if is_sum else out
