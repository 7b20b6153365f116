"""Raster operators on long tables: coordinates, indexes, disaggregation, classes, resampling, sparse form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import PRECIPITATION_LIMITS, Grid


def cell_position(cell: Column, nx: int) -> tuple[Column, Column]:
    """(col, row), both from 1, of a cell number that counts rows from the upper left."""
    return (F.pmod(cell - 1, F.lit(nx)) + 1).cast("int"), (F.floor((cell - 1) / nx) + 1).cast("int")


def coordinate(col: Column, row: Column, g: Grid) -> tuple[Column, Column]:
    """Centre of the cell at (col, row), rows from the top."""
    return F.lit(g.xmin) + (col - 0.5) * g.resx, F.lit(g.ymax) - (row - 0.5) * g.resy


def index(x: Column, y: Column, g: Grid, threshold: float = 0.05) -> tuple[Column, Column]:
    """Arrays of columns and rows that a point belongs to: within ``threshold`` of a border, both neighbours."""

    def both(at: Column, n: int) -> Column:
        ends = F.array_distinct(F.array(F.floor(at - threshold) + 1, F.floor(at + threshold) + 1))
        return F.transform(F.filter(ends, lambda k: (k >= 1) & (k <= n)), lambda k: k.cast("int"))

    return both((x - g.xmin) / g.resx, g.nx), both((F.lit(g.ymax) - y) / g.resy, g.ny)


def disaggregate(raster: DataFrame, layers: DataFrame, keys: tuple[str, ...], weights: Mapping[int, float] | None = None) -> DataFrame:
    """Spread a raster (keys.., v) over proxy layers (keys.., layer, l) by their shares; the cell's total is kept.

    A cell whose layers are all zero is spread evenly, as is whatever shares leave over.
    """
    l = F.col("l")  # noqa: E741
    if weights:
        factors = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        l = l * F.coalesce(F.element_at(factors, F.col("layer")), F.lit(1.0))  # noqa: E741
    cell = Window.partitionBy(*keys)
    shares = layers.withColumn("l", l).withColumn("share", F.coalesce(F.try_divide(F.col("l"), F.sum("l").over(cell)), F.lit(0.0)))
    joined = shares.join(raster, list(keys))
    first = joined.withColumn("part", F.col("v") * F.col("share"))
    rest = (F.col("v") - F.sum("part").over(cell)) / F.count(F.lit(1)).over(cell)
    return first.select(*keys, "layer", (F.col("part") + rest).alias("v"))


def disaggregate_hours(hourly: DataFrame, proxy: DataFrame, steps: int = 12, step: int = 300) -> DataFrame:
    """Hourly cells (t, ix, iy, v) to ``steps`` parts by a proxy at t, t - step, ...; hours lacking a proxy step go.

    An hour needs all its proxy steps to exist; a cell that a step does not list counts as zero there.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit((steps - 1) * step), F.lit(step)))
    wanted = hourly.select("t").distinct().select("t", back.alias("back")).withColumn("s", F.col("t") - F.col("back"))
    there = wanted.join(proxy.select(F.col("t").alias("s")).distinct(), "s")
    whole = there.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == steps).select("t")
    cells = hourly.join(whole, "t", "left_semi").withColumn("layer", back).withColumn("s", F.col("t") - F.col("layer"))
    p = proxy.select(F.col("t").alias("s"), "ix", "iy", F.col("v").alias("l"))
    layers = cells.select("t", "ix", "iy", "layer", "s").join(p, ["s", "ix", "iy"], "left").select("t", "ix", "iy", "layer", F.coalesce("l", F.lit(0.0)).alias("l"))
    out = disaggregate(hourly, layers, ("t", "ix", "iy"))
    return out.select((F.col("t") - F.col("layer")).alias("t"), "ix", "iy", "v")


def classify(v: Column, limits: tuple[float, ...] = PRECIPITATION_LIMITS) -> Column:
    """Class from 1: open below, closed above, the lowest limit included, the last class without end; else null."""
    out = F.when(v == limits[0], 1)
    for k, (lo, hi) in enumerate(zip(limits, (*limits[1:], float("inf")), strict=True), 1):
        out = out.when((v > lo) & (v <= hi), k)
    return out.cast("int")


def resample_nearest(cube: DataFrame, source: Grid, target: Grid, keys: tuple[str, ...] = ("t",), to_source=lambda x, y: (x, y)) -> DataFrame:
    """Nearest-neighbour values on a target grid; ``to_source`` maps target coordinates (columns) to the source's system.

    Target cells are generated from their indexes and meet source cells by index: an equi-join.
    """
    spark = cube.sparkSession
    n = spark.range(target.nx * target.ny)
    tx, ty = (F.col("id") % target.nx).cast("int"), F.floor(F.col("id") / target.nx).cast("int")
    cells = n.select(tx.alias("tx"), ty.alias("ty"))
    x, y = to_source(F.lit(target.xmin) + (F.col("tx") + 0.5) * target.resx, F.lit(target.ymin) + (F.col("ty") + 0.5) * target.resy)
    at = cells.select("tx", "ty", F.floor((x - source.xmin) / source.resx).cast("int").alias("ix"), F.floor((y - source.ymin) / source.resy).cast("int").alias("iy"))
    return cube.join(at, ["ix", "iy"]).select(*keys, "tx", "ty", "v")


def interpolate_pixels(cube: DataFrame, shift: int = 600) -> DataFrame:
    from .temporal import interpolate_at

    return interpolate_at(cube, shift)


def melt_sparse(cube: DataFrame, g: Grid) -> DataFrame:
    """Cells with a value as ``v, row, col, t``, rows from the top and from 1."""
    return cube.where("v is not null").select("v", (F.lit(g.ny) - F.col("iy")).cast("int").alias("row"), (F.col("ix") + 1).cast("int").alias("col"), "t")


def algebra(a: DataFrame, b: DataFrame, f, keys: tuple[str, ...] = ("t", "ix", "iy")) -> DataFrame:
    """Cell-wise f(a, b) of two rasters on the cells of both."""
    joined = a.join(b.withColumnRenamed("v", "w"), list(keys))
    return joined.select(*keys, f(F.col("v"), F.col("w")).alias("v"))
