"""Temporal operators: step grids, snapping, as-of lookup, gap filling, interpolation, de-accumulation, splicing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(spans: DataFrame, seconds: int, cut: bool = True) -> DataFrame:
    """Chunks [t_start, t_end) of each span (id, t0, t1) in seconds; the last one is cut to t1 if asked for."""
    starts = F.explode(F.sequence(F.col("t0"), F.col("t1") - 1, F.lit(seconds).cast("long")))
    out = spans.where("t0 < t1").select("id", "t1", starts.alias("t_start"))
    end = F.col("t_start") + seconds
    return out.select("id", "t_start", (F.least(end, "t1") if cut else end).alias("t_end"))


def step_grid(spark, first: int, last: int, interval: int) -> DataFrame:
    """``i, t``: all steps with a 1-based index."""
    count = (last - first) // interval + 1
    return spark.range(1, count + 1).select(F.col("id").alias("i"), (F.lit(first) + (F.col("id") - 1) * interval).alias("t"))


def timestamp_for_index(i: Column, first: int, interval: int) -> Column:
    return F.lit(first) + (i - 1) * interval


def index_for_timestamp(t: Column, first: int, interval: int) -> Column:
    """The inverse; null between steps."""
    off = t - F.lit(first)
    return F.when(F.pmod(off, F.lit(interval)) == 0, F.floor(off / interval) + 1).cast("long")


def missing_steps(grid: DataFrame, existing: DataFrame, now: Column | None = None, append_only: bool = False) -> DataFrame:
    """Steps of the grid that are not there yet and not in the future; ``append_only`` ignores gaps before the newest."""
    out = grid if now is None else grid.where(F.col("t") <= now)
    if append_only:
        out = out.crossJoin(F.broadcast(existing.agg(F.max("t").alias("newest")))).where(F.col("newest").isNull() | (F.col("t") > F.col("newest"))).drop("newest")
    return out.join(existing.select("t"), "t", "left_anti")


def brackets(probes: DataFrame, series: DataFrame, by: tuple[str, ...] = (), slice_s: int = 86_400) -> DataFrame:
    """For each probe (by.., t): the series' steps ``before`` (last at or before), ``after``, ``first`` and ``last``, or null.

    Both sides are merged and walked once in time order within ``by`` and slices of ``slice_s`` seconds; each slice is
    told the last step before it and the first one after it. So a long series, with or without keys, spreads over its
    slices, and only their edges, a row for each, are ordered as a whole. Null keys are a key.
    """
    keys = list(by)
    part = [*keys, "_slice"]
    union = series.select(*keys, "t", F.lit(0).alias("probe"), F.col("t").alias("s")).unionByName(probes.select(*keys, "t", F.lit(1).alias("probe"), F.lit(None).cast("long").alias("s")))
    union = union.withColumn("_slice", F.floor(F.col("t") / slice_s))
    before_it = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after_it = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    edges = union.groupBy(*part).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select(
        *[F.col(k).alias(f"_{k}") for k in part], F.max("hi").over(before_it).alias("earlier"), F.min("lo").over(after_it).alias("later"),
        F.min("lo").over(whole).alias("first"), F.max("hi").over(whole).alias("last"),
    )
    ahead = Window.partitionBy(*part).orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*part).orderBy(F.desc("t"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    walked = union.select(*part, "t", "probe", F.last("s", True).over(ahead).alias("before"), F.last("s", True).over(back).alias("after")).where("probe = 1")
    told = walked.join(edges, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in part]))
    return told.select(*keys, "t", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"), "first", "last")


def as_of(probes: DataFrame, series: DataFrame, direction: str = "leq", by: tuple[str, ...] = (), slice_s: int = 86_400) -> DataFrame:
    """For each probe (by.., t) the step of the series: ``leq`` last at or before, ``geq`` first at or after, ``both`` nearest.

    Outside the data, leq falls back to the first step and geq to the last. For equal distances ``both`` takes the
    earlier.
    """
    nearest = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    found = {"leq": F.coalesce("before", "first"), "geq": F.coalesce("after", "last"), "both": nearest}
    if direction not in found:
        raise ValueError("direction is leq, geq or both")
    return brackets(probes, series, by, slice_s).select(*by, "t", found[direction].alias("found"))


def ceil_hour(ts: Column) -> Column:
    """Seconds of the full hour at or after a timestamp: right-closed buckets, in whole numbers."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return (F.ceil(micros / F.lit(3_600_000_000)) * 3600).cast("long")


def hourly_mean(series: DataFrame, by: tuple[str, ...] = ("station",)) -> DataFrame:
    return series.groupBy(*by, ceil_hour(F.col("ts")).alias("hour")).agg(F.avg("v").alias("v"))


def deaccumulate(runs: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Step values from running totals: each less the one before; the first stays."""
    order = Window.partitionBy(*keys).orderBy("f")
    return runs.withColumn("step", F.col("v") - F.coalesce(F.lag("v").over(order), F.lit(0.0)))


def complete_runs(runs: DataFrame, expected: Column) -> DataFrame:
    """Runs (key ``run``) whose number of distinct steps is the expected one."""
    return runs.groupBy("run").agg(F.countDistinct("f").alias("steps")).where(F.col("steps") == expected)


def latest_run(runs: DataFrame, requests: DataFrame, full: Column, short_steps: int, full_steps: int) -> DataFrame:
    """Steps of the newest run at or before each request (id, t): all of a full run, else the short horizon.

    ``full`` is a condition on column ``run``.
    """
    known = runs.select(F.col("run").alias("t")).distinct()
    chosen = as_of(requests.select("t"), known, "leq").where("found <= t").distinct().select("t", F.col("found").alias("run"))
    joined = requests.join(chosen, "t").join(runs, "run")
    return joined.where(F.col("f") <= F.when(full, full_steps).otherwise(short_steps)).select("id", "t", "run", "f", "v")


def gap_fill(series: DataFrame, by: tuple[str, ...], start: Column, end: Column, step: str = "1 day", on: str = "date") -> DataFrame:
    """One row per calendar step for each key, nulls where the series has none."""
    keys = series.select(*by).distinct()
    calendar = keys.select(*by, F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias(on))
    return calendar.join(series, [*by, on], "left")


def trim(series: DataFrame, value: str, by: tuple[str, ...], on: str = "date") -> DataFrame:
    """From the first to the last row with a value; keys without any value go."""
    whole = Window.partitionBy(*by)
    present = F.when(F.col(value).isNotNull(), F.col(on))
    out = series.withColumn("_lo", F.min(present).over(whole)).withColumn("_hi", F.max(present).over(whole))
    return out.where(F.col(on).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def interpolate(series: DataFrame, value: str, x: Column, by: tuple[str, ...], on: str = "date") -> DataFrame:
    """Linear over gaps inside the series; ``x`` is the position as a number. Leading and trailing nulls stay."""
    back = Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(on).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).alias("v")))
    p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
    line = p["v"] + (q["v"] - p["v"]) * F.try_divide(x - p["x"], q["x"] - p["x"])
    return series.withColumn(value, F.coalesce(F.col(value), line))


def interpolate_at(cube: DataFrame, shift: int = 600, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Each cell's series at its own steps moved by ``shift`` seconds; null outside the series.

    Every shifted step lies between two steps of the cell or at one: the bracket is found by one walk.
    """
    data = cube.where("v is not null").select(*keys, "t", F.struct("t", "v").alias("k"), F.lit(0).alias("asked"))
    asked = cube.select(*keys, (F.col("t") + shift).alias("t"), F.lit(None).cast("struct<t:bigint,v:double>").alias("k"), F.lit(1).alias("asked"))
    union = data.unionByName(asked)
    back = Window.partitionBy(*keys).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    walked = union.select(*keys, "t", "asked", F.last("k", True).over(back).alias("p"), F.last("k", True).over(ahead).alias("q")).where("asked = 1")
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0))
    return walked.select(*keys, "t", F.when(F.col("p.t") == F.col("q.t"), F.col("p.v")).otherwise(line).alias("v"))


def splice(observed: DataFrame, forecast: DataFrame, shift: int = 600) -> DataFrame:
    """Observations (t, v), moved by ``shift``, and forecast steps (run, f, v) at run + f hours where none is observed."""
    seen = observed.select((F.col("t") + shift).alias("t"), "v", F.lit("observed").alias("kind"))
    valid = forecast.select((F.col("run") + F.col("f") * 3600).alias("t"), "v", F.lit("forecast").alias("kind"))
    return seen.unionByName(valid.join(seen, "t", "left_anti"))


def comma_series(series: DataFrame, by: tuple[str, ...], on: str = "t") -> DataFrame:
    """Ordered values and times as comma-joined text, one row per key."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(on).alias("t"), F.col("v").alias("v"))))
    join = lambda name: F.array_join(F.transform(rows, lambda r: r[name].cast("string")), ",")
    return series.groupBy(*by).agg(join("t").alias("times"), join("v").alias("vals"))


def parse_reply(reply: Column) -> Column:
    """Rows (t, v) of a two-line reply: values, then times, comma-separated."""
    lines = F.split(reply, "\n")
    cut = lambda i: F.split(F.get(lines, F.lit(i)), ",")
    return F.zip_with(cut(0), cut(1), lambda v, t: F.struct(t.alias("t"), v.try_cast("double").alias("v")))


def full_outer(series: list[DataFrame], on: str = "date") -> DataFrame:
    """N series joined on one column, every value of it kept."""
    out = series[0]
    for other in series[1:]:
        out = out.join(other, on, "full")
    return out


def model_window(end: Column, years: int) -> tuple[Column, Column]:
    """Start (years of 372 days before, at midnight) and end of a simulation, both an hour on, in seconds."""
    start = F.floor((end - years * 12 * 31 * 86_400) / 86_400) * 86_400
    return (start + 3600).cast("long"), end + 3600
