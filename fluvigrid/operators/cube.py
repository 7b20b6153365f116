"""Cube queries: slices, snapping to steps, statistics per step, and storage as a partitioned table."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.catalog import FULL_HORIZON, Product
from .temporal import brackets

Reducer = Callable[[Column], Column]

#: The statistics of an extent query. Missing cells are skipped; a step without any data sums to 0.
EXTENT_STATISTICS: Mapping[str, Reducer] = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "sd": F.stddev_samp,
}


def subset(cube: DataFrame, box: tuple[int, int, int, int] | None = None, t: tuple[int, int] | None = None, f: tuple[int, int] | None = None) -> DataFrame:
    """Hyperslab by index box (ix0, ix1, iy0, iy1), time range and forecast range: predicates that reach the scan."""
    out = cube
    if box is not None:
        out = out.where(F.col("ix").between(box[0], box[1]) & F.col("iy").between(box[2], box[3]))
    if t is not None:
        out = out.where(F.col("t").between(*t))
    return out.where(F.col("f").between(*f)) if f is not None else out


def statistics(cube: DataFrame, by: tuple[str, ...] = ("t",), value: str = "v", fun: Mapping[str, Reducer] = EXTENT_STATISTICS, compat: bool = False) -> DataFrame:
    """One row of statistics per step. ``fun`` maps names to reducers of the value column.

    With ``compat`` the minimum and maximum of a step without data are infinite, as marks of no data.
    """
    out = cube.groupBy(*by).agg(*[f(F.col(value)).alias(name) for name, f in fun.items()])
    if compat:
        for name, mark in (("min", "Infinity"), ("max", "-Infinity")):
            if name in fun:
                out = out.withColumn(name, F.coalesce(name, F.lit(float(mark.replace("Infinity", "inf")))))
    return out


def finite(stats: DataFrame) -> DataFrame:
    """Only steps with data: a null or infinite minimum marks the others."""
    return stats.where(F.col("min").isNotNull() & (F.abs("min") != float("inf")))


def index_box(xs: DataFrame, lo: float, hi: float, cell: float, axis: str = "x") -> DataFrame:
    """``first, last`` of an axis's coordinates within [lo - cell/2, hi + cell/2], clamped to the axis's ends."""
    x = F.col(axis)
    return xs.agg(
        F.coalesce(F.min(F.when(x >= lo - cell / 2, x)), F.max(x)).alias("first"), F.coalesce(F.max(F.when(x <= hi + cell / 2, x)), F.min(x)).alias("last")
    )


def outer_edges(xs: DataFrame, cell: float, axis: str = "x") -> DataFrame:
    """The inverse: outer edges of the cells that the coordinates are centres of."""
    return xs.agg((F.min(axis) - cell / 2).alias("lo"), (F.max(axis) + cell / 2).alias("hi"))


def snap(cube: DataFrame, requests: DataFrame, slice_s: int = 86_400) -> DataFrame:
    """Steps for each request (id, t0, t1): from the last step <= t0 to the first step >= t1, the widened range.

    Bounds beyond the data clamp to them where the range still meets the data; a range wholly before or after is
    empty. Bounds are as-of lookups, and steps meet the widened ranges on slices of time, so requests may be many.
    """
    steps = cube.select("t").distinct()
    found = brackets(requests.select(F.explode(F.array("t0", "t1")).alias("t")).distinct(), steps, slice_s=slice_s)
    low = found.select(F.col("t").alias("t0"), F.coalesce("before", "first").alias("lo"), "first", "last")
    high = found.select(F.col("t").alias("t1"), F.coalesce("after", "last").alias("hi"))
    bounds = requests.join(low, "t0").join(high, "t1").where((F.col("t1") >= F.col("first")) & (F.col("t0") <= F.col("last")))
    slice_of = lambda c: F.floor(F.col(c) / slice_s)
    spread = bounds.select("id", "lo", "hi", F.explode(F.sequence(slice_of("lo"), slice_of("hi"))).alias("_slice"))
    return steps.withColumn("_slice", slice_of("t")).join(spread, "_slice").where(F.col("t").between(F.col("lo"), F.col("hi"))).select("id", "t")


def timestamps(cube: DataFrame, iso: bool = False, latest: bool = False) -> DataFrame:
    """Distinct steps, or the newest; as seconds, or as ISO text in UTC."""
    out = cube.agg(F.max("t").alias("t")) if latest else cube.select("t").distinct()
    return out.withColumn("iso", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")) if iso else out


def mask_statistics(cube: DataFrame, overlap: DataFrame, by: tuple[str, ...] = ("t",), renormalize: bool = False) -> DataFrame:
    """Weighted statistics per polygon and step from an overlap table (id, ix, iy, weight, size, weight_norm).

    Missing cells drop out without renormalising (unless asked for), so a step without data has mean 0. The sum is
    the mean times the covered area. ``max`` and ``min`` are over covered cells. Overlaps are a dimension table:
    the join is on cells and its small side is left to adaptive execution.
    """
    area = overlap.groupBy("id").agg(F.sum(F.col("weight") * F.col("size")).alias("area"))
    joined = cube.join(overlap.where("weight > 0"), ["ix", "iy"])
    weighted = F.coalesce(F.sum(F.col("v") * F.col("weight_norm")), F.lit(0.0))
    if renormalize:
        weighted = F.try_divide(F.sum(F.col("v") * F.col("weight_norm")), F.sum(F.when(F.col("v").isNotNull(), F.col("weight_norm"))))
    out = joined.groupBy("id", *by).agg(weighted.alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))
    return out.join(area, "id").select("id", *by, "mean", "max", "min", (F.col("mean") * F.col("area")).alias("sum"))


def request(cube: DataFrame, box: tuple[int, int, int, int] | None = None, overlap: DataFrame | None = None, t: tuple[int, int] | None = None, by: tuple[str, ...] = ("t",), stats: bool = True) -> DataFrame:
    """One question to a cube: the whole extent, an index box or polygons (an overlap table); statistics per step, of
    steps with data only, or the cells themselves. Of polygons the cells come with id and weights."""
    if box is not None and overlap is not None:
        raise ValueError("ask for a box or for polygons")
    data = subset(cube, box, t)
    if overlap is None:
        return finite(statistics(data, by)) if stats else data
    return finite(mask_statistics(data, overlap, by)) if stats else data.join(overlap.where("weight > 0"), ["ix", "iy"])


def dropped(stats: DataFrame) -> DataFrame:
    """``n, without_data``: the number of steps and of those that ``finite`` leaves out."""
    kept = F.col("min").isNotNull() & (F.abs("min") != float("inf"))
    return stats.agg(F.count(F.lit(1)).alias("n"), F.count_if(~kept).alias("without_data"))


def transparent(cube: DataFrame) -> DataFrame:
    """Zeros become missing."""
    return cube.withColumn("v", F.nullif("v", F.lit(0.0)))


# Storage. A cube is a Parquet table partitioned by year, sorted by cell and step inside its files, so that row groups
# hold few cells: the counterpart of chunks that are short in space and long in time.


def write_cube(cube: DataFrame, path: str, partitions: int | None = None, codec: str = "zstd", attributes: Mapping[str, str] | None = None) -> None:
    """Write whole years: those that ``cube`` holds are replaced, others stay. ``append_steps`` and ``replace_steps`` write single steps."""
    keyed = cube.withColumn("year", F.year(F.timestamp_seconds("t")))
    dealt = keyed.repartitionByRange(partitions, "year", "iy", "ix") if partitions else keyed.repartitionByRange("year", "iy", "ix")
    writer = dealt.sortWithinPartitions("year", "iy", "ix", "t").write.partitionBy("year").option("compression", codec)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    if attributes:
        spark = cube.sparkSession
        spark.createDataFrame([(json.dumps(dict(attributes)),)], "attributes string").coalesce(1).write.mode("overwrite").text(f"{path}.attributes")


def create_cube(spark: SparkSession, path: str, product: Product, forecast: bool = False) -> None:
    """A cube of a product without any step, as its schema and attributes; one that is there is an error. Forecast cubes
    have the axes run and f (hours from 0 to the horizon) in the place of t."""
    g = product.grid
    facts = {"schema": f"{'run bigint, f int' if forecast else 't bigint'}, ix int, iy int, v double, year int", "t": "seconds since 1970-01-01 00:00"}
    facts |= {"x": f"{g.xmin + g.resx / 2} {g.resx} {g.nx}", "y": f"{g.ymin + g.resy / 2} {g.resy} {g.ny}", "crs": product.crs, "phenomenon": product.phenomenon, "uom": product.uom}
    facts |= {"f": f"hours 0 {FULL_HORIZON}"} if forecast else {}
    spark.createDataFrame([(json.dumps(facts),)], "attributes string").coalesce(1).write.mode("error").text(f"{path}.attributes")


def open_cube(spark: SparkSession, path: str) -> DataFrame:
    """A cube that ``create_cube`` made; empty where no step has been written yet."""
    schema = attribute(spark, path, "schema")
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_steps(cube: DataFrame, path: str) -> None:
    """Add the cells that the table lacks; what is there stays, so a retry adds nothing. Only touched years are read."""
    keyed = cube.withColumn("year", F.year(F.timestamp_seconds("t"))).dropDuplicates(["t", "ix", "iy"])
    try:
        there = cube.sparkSession.read.parquet(path).select("year", "t", "ix", "iy")
    except AnalysisException:
        there = None
    if there is not None:
        keyed = keyed.join(there, ["year", "t", "ix", "iy"], "left_anti")
    keyed.write.partitionBy("year").mode("append").parquet(path)


def replace_steps(cube: DataFrame, path: str, staging: str) -> None:
    """Put the steps of ``cube`` in the place of those that are there; other steps of their years stay.

    The years that are touched are written to ``staging``, a path in shared storage, before the table's are replaced,
    so a job that is cut off can be run again.
    """
    spark = cube.sparkSession
    keyed = cube.withColumn("year", F.year(F.timestamp_seconds("t")))
    old = spark.read.parquet(path)
    rest = old.join(keyed.select("year").distinct(), "year", "left_semi").join(keyed.select("year", "t").distinct(), ["year", "t"], "left_anti")
    rest.select(*cube.columns).unionByName(cube).write.mode("overwrite").parquet(staging)
    write_cube(spark.read.schema(cube.schema).parquet(staging), path)


def read_cube(spark: SparkSession, path: str, t: tuple[int, int] | None = None) -> DataFrame:
    """Read a cube; a time range also prunes years."""
    out = spark.read.parquet(path)
    if t is not None:
        year = lambda s: F.year(F.timestamp_seconds(F.lit(s)))
        out = out.where(F.col("year").between(year(t[0]), year(t[1])) & F.col("t").between(*t))
    return out


def attribute(spark: SparkSession, path: str, name: str) -> str | None:
    """A table attribute that ``write_cube`` stored."""
    return json.loads(spark.read.text(f"{path}.attributes").first()[0]).get(name)


def rechunk(spark: SparkSession, source: str, target: str, partitions: int, codec: str = "zstd") -> None:
    """Copy a cube into another file layout."""
    write_cube(spark.read.parquet(source).drop("year"), target, partitions, codec)
