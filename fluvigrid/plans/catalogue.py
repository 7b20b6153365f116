"""Registered queries of the weather and river engine, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, hydro, scalar
from ..operators import cube, graph, raster, stations, temporal, zonal
from ..sources import adapters, radar, services
from ..streaming import ingest
from . import app, brook90
from ..sources.catalog import FORECAST as FORECASTS
from ..sources.catalog import RADAR, Grid

DAY = 86_400
FIRST_DAY = 1_704_067_200  # 2024-01-01, where the event tables begin


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six digits: sums of doubles depend on their order beyond that."""
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


# SQL views of the adapted tables, shared by the oracles.
CUBE = """cube AS (
  SELECT epoch(date_trunc('day', ts))::BIGINT AS t, (event_id % 16)::INT AS ix, ((event_id // 16) % 16)::INT AS iy,
    sum(CASE WHEN event_id % 7 <> 0 THEN value::DECIMAL(18,2) END)::DOUBLE AS v
  FROM events GROUP BY 1, 2, 3)"""
HOURLY = CUBE.replace("'day'", "'hour'")
FORECAST = """forecast AS (
  SELECT epoch(o_orderdate)::BIGINT AS run, l_linenumber AS f, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
STATIONS = """stations AS (
  SELECT s_suppkey AS station, 11.0 + (s_suppkey * 37 % 500) / 100.0 AS lon, 50.0 + (s_suppkey * 61 % 200) / 100.0 AS lat,
    s_acctbal / 10 AS height FROM supplier)"""
BOXES = """boxes AS (
  SELECT n_nationkey AS id, 0.25::DOUBLE + (n_nationkey % 5) * 3.1::DOUBLE AS xmin, 0.25::DOUBLE + (n_nationkey % 5) * 3.1::DOUBLE + 2.6::DOUBLE AS xmax,
    0.5::DOUBLE + (n_nationkey // 5) * 3.1::DOUBLE AS ymin, 0.5::DOUBLE + (n_nationkey // 5) * 3.1::DOUBLE + 2.6::DOUBLE AS ymax FROM nation)"""
OVERLAP = BOXES + """, cells AS (
  SELECT a.i::INT AS ix, b.i::INT AS iy FROM range(16) a(i), range(16) b(i)),
raw AS (
  SELECT id, ix, iy, ((15 - iy) * 16 + ix + 1)::INT AS cell, ix + 0.5::DOUBLE AS x, iy + 0.5::DOUBLE AS y, 1.0::DOUBLE AS size,
    greatest(0, least(xmax, ix + 1) - greatest(xmin, ix)) * greatest(0, least(ymax, iy + 1) - greatest(ymin, iy)) AS weight
  FROM boxes, cells),
overlap AS (
  SELECT *, weight / sum(weight) OVER (PARTITION BY id) AS weight_norm FROM raw WHERE weight > 0)"""
CATCHMENTS = """catchments AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN -1 ELSE p_partkey // 2 END AS next, p_retailprice / 100 AS area_sqkm FROM part)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {CUBE}
SELECT t, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max,
  coalesce(sum(v::DECIMAL(18,2)), 0)::DOUBLE AS sum, round(stddev_samp(v), 6) AS sd
FROM cube WHERE ix BETWEEN 2 AND 11 AND iy BETWEEN 3 AND 12 GROUP BY t""")
def cube_extent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fun = cube.EXTENT_STATISTICS | {"sum": lambda v: F.coalesce(adapters.exact_sum(v), F.lit(0.0))}
    out = cube.statistics(cube.subset(adapters.cube(spark, sf_dir), (2, 11, 3, 12)), fun=fun)
    return r6(out, "mean", "median", "sd")


@query(f"""WITH {FORECAST}
SELECT run, f, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max,
  coalesce(sum(v::DECIMAL(18,2)), 0)::DOUBLE AS sum, round(stddev_samp(v), 6) AS sd FROM forecast GROUP BY run, f""")
def cube_extent_stats_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fun = cube.EXTENT_STATISTICS | {"sum": lambda v: F.coalesce(adapters.exact_sum(v), F.lit(0.0))}
    return r6(cube.statistics(adapters.forecast(spark, sf_dir), ("run", "f"), fun=fun), "mean", "median", "sd")


_SNAP = """, bounds AS (
  SELECT q.id, coalesce(max(t) FILTER (t <= t0), min(t)) AS lo, coalesce(min(t) FILTER (t >= t1), max(t)) AS hi
  FROM requests q, steps GROUP BY q.id, t0, t1 HAVING t1 >= min(t) AND t0 <= max(t))
SELECT id, t FROM bounds JOIN steps ON t BETWEEN lo AND hi"""


def _requests(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "id int, t0 bigint, t1 bigint")


@query(f"""WITH {CUBE}, steps AS (SELECT DISTINCT t FROM cube), requests(id, t0, t1) AS (
  VALUES (1, {FIRST_DAY + 3 * DAY + 100}, {FIRST_DAY + 6 * DAY + 100}), (2, {FIRST_DAY - 9 * DAY}, {FIRST_DAY + DAY}),
    (3, {FIRST_DAY - 9 * DAY}, {FIRST_DAY - 5 * DAY}), (4, {FIRST_DAY + 2 * DAY}, {FIRST_DAY + 2 * DAY})){_SNAP}""")
def cube_time_snap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [(1, FIRST_DAY + 3 * DAY + 100, FIRST_DAY + 6 * DAY + 100), (2, FIRST_DAY - 9 * DAY, FIRST_DAY + DAY), (3, FIRST_DAY - 9 * DAY, FIRST_DAY - 5 * DAY), (4, FIRST_DAY + 2 * DAY, FIRST_DAY + 2 * DAY)]
    return cube.snap(adapters.cube(spark, sf_dir), _requests(spark, wanted))


@query(f"""WITH {CUBE}, steps AS (SELECT DISTINCT t FROM cube), requests(id, t0, t1) AS (
  VALUES (1, {FIRST_DAY + 4 * DAY + 7}, {FIRST_DAY + 4 * DAY + 7})), snapped AS (WITH x AS (SELECT 1){_SNAP})
SELECT t, ix, iy, v FROM cube SEMI JOIN snapped USING (t)""")
def cube_single_instant_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = adapters.cube(spark, sf_dir)
    steps = cube.snap(data, _requests(spark, [(1, FIRST_DAY + 4 * DAY + 7, FIRST_DAY + 4 * DAY + 7)]))
    return data.join(steps.select("t"), "t", "left_semi").select("t", "ix", "iy", "v")


@query(f"""WITH {HOURLY} SELECT DISTINCT t, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, t = (SELECT max(t) FROM cube) AS latest FROM cube""")
def cube_timestamps_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = adapters.cube(spark, sf_dir, 3600)
    newest = cube.timestamps(data, latest=True).withColumnRenamed("t", "newest")
    return cube.timestamps(data, iso=True).crossJoin(F.broadcast(newest)).select("t", "iso", (F.col("t") == F.col("newest")).alias("latest"))


@query(f"""WITH {CUBE}, xs AS (SELECT DISTINCT ix::DOUBLE AS x FROM cube)
SELECT coalesce(min(x) FILTER (x >= 2.6 - 0.5), max(x)) AS first, coalesce(max(x) FILTER (x <= 40.2 + 0.5), min(x)) AS last FROM xs""")
def cube_index_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = adapters.cube(spark, sf_dir).select(F.col("ix").cast("double").alias("x")).distinct()
    return cube.index_box(xs, 2.6, 40.2, 1.0)


@query(f"""WITH {OVERLAP} SELECT id, ix, iy, cell, x, y, size, round(weight, 6) AS weight, round(weight_norm, 6) AS weight_norm FROM overlap""")
def zonal_overlap_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(zonal.overlap_boxes(adapters.boxes(spark, sf_dir)), "weight", "weight_norm")


@query(f"""WITH {OVERLAP} SELECT id, ix, iy, cell, x, y, size, round(weight, 6) AS weight, round(weight_norm, 6) AS weight_norm FROM overlap""")
def zonal_overlap_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    polys = zonal.box_rings(adapters.boxes(spark, sf_dir))
    return r6(zonal.overlap_polygons(polys), "weight", "weight_norm")


@query(f"""WITH {OVERLAP}, {CUBE}, area AS (SELECT id, sum(weight * size) AS area FROM overlap GROUP BY id),
stats AS (SELECT id, t, coalesce(sum(v * weight_norm), 0) AS mean, max(v) AS max, min(v) AS min FROM cube JOIN overlap USING (ix, iy) GROUP BY id, t)
SELECT id, t, round(mean, 6) AS mean, max, min, round(mean * area, 6) AS sum FROM stats JOIN area USING (id)""")
def zonal_mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(cube.mask_statistics(adapters.cube(spark, sf_dir), zonal.overlap_boxes(adapters.boxes(spark, sf_dir))), "mean", "sum")


@query(f"""WITH {OVERLAP}, {CUBE}, stats AS (
  SELECT id, t, min(v) AS min, max(v) AS max, CASE WHEN count(v) = count(*) THEN sum(v * weight) END AS mean, sum(size) AS size
  FROM cube JOIN overlap USING (ix, iy) GROUP BY id, t)
SELECT id, t, min, max, round(mean, 6) AS mean, round(mean * size, 6) AS sum FROM stats""")
def zonal_stats_unnormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(zonal.zonal_statistics(adapters.cube(spark, sf_dir), zonal.overlap_boxes(adapters.boxes(spark, sf_dir))), "mean", "sum")


@query(f"""WITH {BOXES}, points AS (SELECT s_suppkey AS pid, (s_suppkey * 37 % 160) / 10.0::DOUBLE + 0.03 AS x, (s_suppkey * 61 % 160) / 10.0::DOUBLE + 0.03 AS y FROM supplier)
SELECT pid, round(x, 6) AS x, round(y, 6) AS y, min(id)::INT AS id FROM points LEFT JOIN boxes ON x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY pid, x, y""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    points = adapters.table(spark, sf_dir, "supplier").select(k.alias("pid"), (k * 37 % 160 / 10 + 0.03).alias("x"), (k * 61 % 160 / 10 + 0.03).alias("y"))
    return r6(zonal.locate(points, zonal.box_rings(adapters.boxes(spark, sf_dir))), "x", "y")


@query(f"""WITH {OVERLAP}, merged AS (
  SELECT n_regionkey AS id, ix, iy, cell, x, y, size, least(1.0, sum(weight)) AS weight FROM overlap JOIN nation ON id = n_nationkey GROUP BY ALL)
SELECT id, ix, iy, cell, x, y, size, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY id), 6) AS weight_norm FROM merged""")
def zonal_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("group"))
    return r6(zonal.dissolve(zonal.overlap_boxes(adapters.boxes(spark, sf_dir)), groups), "weight", "weight_norm")


@query(f"""WITH {BOXES} SELECT id, round((xmin + xmax) / 2, 6) AS x, round((ymin + ymax) / 2, 6) AS y FROM boxes""")
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    polys = zonal.box_rings(adapters.boxes(spark, sf_dir)).select("id", zonal.centroid(F.col("rings")).alias("c"))
    return r6(polys.select("id", "c.x", "c.y"), "x", "y")


_SERIES = "series AS (SELECT DISTINCT user_id % 5 AS k, (epoch_us(ts) // 1000000) AS t FROM events), probes AS (SELECT DISTINCT user_id % 5 AS k, epoch(date_trunc('hour', ts))::BIGINT AS t FROM events)"


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = adapters.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), adapters.epoch(F.col("ts")).alias("t"))
    return e.distinct(), e.select("k", (F.floor(F.col("t") / 3600) * 3600).cast("long").alias("t")).distinct()


_ASOF = f"""WITH {_SERIES}, ends AS (SELECT k, min(t) AS first, max(t) AS last FROM series GROUP BY k),
a AS (SELECT p.k, p.t, s.t AS before FROM probes p ASOF LEFT JOIN series s ON p.k = s.k AND p.t >= s.t),
b AS (SELECT p.k, p.t, s.t AS after FROM probes p ASOF LEFT JOIN series s ON p.k = s.k AND p.t <= s.t)
SELECT k, t, @found AS found FROM a JOIN b USING (k, t) JOIN ends USING (k)"""


@query(_ASOF.replace("@found", "coalesce(before, first)"))
def asof_leq(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, probes = _series(spark, sf_dir)
    return temporal.as_of(probes, series, "leq", ("k",))


@query(_ASOF.replace("@found", "coalesce(after, last)"))
def asof_geq(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, probes = _series(spark, sf_dir)
    return temporal.as_of(probes, series, "geq", ("k",))


@query(_ASOF.replace("@found", "CASE WHEN after IS NULL OR t - before <= after - t THEN before ELSE after END"))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, probes = _series(spark, sf_dir)
    return temporal.as_of(probes, series, "both", ("k",))


@query(f"""WITH {FORECAST}, requests AS (SELECT DISTINCT c_custkey % 40 AS id, (SELECT min(run) FROM forecast) + (c_custkey % 40) * 5184000 + 77 AS t FROM customer),
chosen AS (SELECT q.id, q.t, max(run) AS run FROM requests q JOIN forecast ON run <= t GROUP BY q.id, q.t)
SELECT id, t, run, f, v FROM chosen JOIN forecast USING (run) WHERE f <= CASE WHEN (run // 86400) % 2 = 0 THEN 7 ELSE 4 END""")
def forecast_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.forecast(spark, sf_dir)
    base = runs.agg(F.min("run").alias("base"))
    k = (F.col("c_custkey") % 40).alias("id")
    requests = adapters.table(spark, sf_dir, "customer").select(k).distinct().crossJoin(F.broadcast(base)).select("id", (F.col("base") + F.col("id") * 5_184_000 + 77).alias("t"))
    return temporal.latest_run(runs, requests, F.floor(F.col("run") / DAY) % 2 == 0, 4, 7)


@query(f"""WITH {FORECAST} SELECT run, f, v, round(v - coalesce(lag(v) OVER (PARTITION BY run ORDER BY f), 0), 6) AS step FROM forecast""")
def deaccumulate_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(temporal.deaccumulate(adapters.forecast(spark, sf_dir)), "step")


@query(f"""WITH {FORECAST} SELECT run, count(DISTINCT f) AS steps FROM forecast GROUP BY run HAVING count(DISTINCT f) = 7""")
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.complete_runs(adapters.forecast(spark, sf_dir), F.lit(7))


@query(f"""SELECT {FIRST_DAY} + i * 600 AS t FROM range(4320) r(i) WHERE {FIRST_DAY} + i * 600 NOT IN (SELECT (epoch_us(ts) // 1000000) // 600 * 600 FROM events)""")
def missing_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = adapters.table(spark, sf_dir, "events").select((F.floor(adapters.epoch(F.col("ts")) / 600) * 600).cast("long").alias("t")).distinct()
    return temporal.missing_steps(temporal.step_grid(spark, FIRST_DAY, FIRST_DAY + 4319 * 600, 600).select("t"), there)


@query(f"""WITH steps AS (SELECT DISTINCT (epoch_us(ts) // 1000000) // 600 * 600 AS t FROM events), wanted AS (SELECT {FIRST_DAY} + i * 600 AS target FROM range(4320) r(i))
SELECT target, max(t) AS t FROM wanted LEFT JOIN steps ON t <= target AND t >= target - 3000 GROUP BY target""")
def fallback_previous_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = adapters.table(spark, sf_dir, "events").select((F.floor(adapters.epoch(F.col("ts")) / 600) * 600).cast("long").alias("t")).distinct()
    wanted = temporal.step_grid(spark, FIRST_DAY, FIRST_DAY + 4319 * 600, 600).select(F.col("t").alias("target"))
    tries = wanted.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.col("target") - k * 600)))
    return tries.join(there.withColumn("there", F.lit(True)), "t", "left").groupBy("target").agg(F.max(F.when(F.col("there"), F.col("t"))).alias("t"))


@query("""WITH spans AS (SELECT c_custkey AS id, c_custkey * 1000 AS t0, c_custkey * 1000 + c_custkey % 97 * 100 AS t1 FROM customer)
SELECT id, t0 + i * 900 AS t_start, least(t0 + i * 900 + 900, t1) AS t_end FROM spans, range(12) r(i) WHERE t0 + i * 900 < t1""")
def time_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    spans = adapters.table(spark, sf_dir, "customer").select(k.alias("id"), (k * 1000).alias("t0"), (k * 1000 + k % 97 * 100).alias("t1"))
    return temporal.intervals(spans, 900)


@query(f"""WITH x AS (SELECT DISTINCT (epoch_us(ts) // 1000000) AS t FROM events), y AS (SELECT t, CASE WHEN (t - {FIRST_DAY}) % 3600 = 0 THEN (t - {FIRST_DAY}) // 3600 + 1 END AS i FROM (SELECT t FROM x UNION SELECT t // 3600 * 3600 FROM x))
SELECT t, i, {FIRST_DAY} + (i - 1) * 3600 AS back FROM y""")
def index_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.table(spark, sf_dir, "events").select(adapters.epoch(F.col("ts")).alias("t"))
    both = t.union(t.select((F.floor(F.col("t") / 3600) * 3600).cast("long"))).distinct()
    i = both.withColumn("i", temporal.index_for_timestamp(F.col("t"), FIRST_DAY, 3600))
    return i.withColumn("back", temporal.timestamp_for_index(F.col("i"), FIRST_DAY, 3600))


_G9 = Grid(-523.0, 377.0, -4658.0, -3758.0, 900, 900)


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 4057 % 810000 + 1)::INT AS cell FROM part),
c AS (SELECT *, ((cell - 1) % 900 + 1)::INT AS col, ((cell - 1) // 900 + 1)::INT AS row FROM p)
SELECT id, cell, col, row, -523.0::DOUBLE + (col - 0.5::DOUBLE) AS x, -3758.0::DOUBLE - (row - 0.5::DOUBLE) AS y FROM c""")
def grid_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 4057 % 810_000 + 1).cast("int").alias("cell"))
    col, row = raster.cell_position(F.col("cell"), 900)
    placed = cells.select("id", "cell", col.alias("col"), row.alias("row"))
    x, y = raster.coordinate(F.col("col"), F.col("row"), _G9)
    return placed.select("id", "cell", "col", "row", x.alias("x"), y.alias("y"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 7 % 9000) / 10.0::DOUBLE AS x, (p_partkey * 13 % 9000) / 10.0::DOUBLE AS y FROM part),
q AS (SELECT id, floor(x - 0.05) + 1 AS a, floor(x + 0.05) + 1 AS b, floor(y - 0.05) + 1 AS c, floor(y + 0.05) + 1 AS d FROM p),
cols AS (SELECT DISTINCT id, unnest([a, b])::INT AS col FROM q), rows AS (SELECT DISTINCT id, unnest([c, d])::INT AS row FROM q)
SELECT id, col, row FROM cols JOIN rows USING (id) WHERE col BETWEEN 1 AND 900 AND row BETWEEN 1 AND 900""")
def grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Grid(0.0, 900.0, 0.0, 900.0, 900, 900)
    k = F.col("p_partkey")
    points = adapters.table(spark, sf_dir, "part").select(k.alias("id"), (k * 7 % 9000 / 10).alias("x"), (k * 13 % 9000 / 10).alias("y"))
    col, row = raster.index(F.col("x"), F.lit(900.0) - F.col("y"), g)
    return points.select("id", F.explode(col).alias("col"), row.alias("rows")).select("id", "col", F.explode("rows").alias("row"))


_RW = """hourly AS (SELECT epoch(date_trunc('hour', ts))::BIGINT + 3600 AS t, (event_id % 2)::INT AS ix, 0 AS iy, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM events GROUP BY 1, 2),
proxy AS (SELECT (epoch_us(ts) // 1000000) // 300 * 300 AS t, (event_id % 2)::INT AS ix, 0 AS iy, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_RW}, wanted AS (SELECT DISTINCT t, t - i * 300 AS s, i * 300 AS layer FROM hourly, range(4) r(i)),
whole AS (SELECT t FROM wanted JOIN (SELECT DISTINCT t AS s FROM proxy) USING (s) GROUP BY t HAVING count(*) = 4),
layers AS (SELECT h.t, h.ix, h.iy, w.layer, h.v, coalesce(p.v, 0) AS l FROM hourly h SEMI JOIN whole USING (t) JOIN wanted w USING (t) LEFT JOIN proxy p ON p.t = w.s AND p.ix = h.ix AND p.iy = h.iy),
parts AS (SELECT *, v * CASE WHEN sum(l) OVER c = 0 THEN 0 ELSE l / sum(l) OVER c END AS part FROM layers WINDOW c AS (PARTITION BY t, ix, iy))
SELECT t - layer AS t, ix, iy, round(part + (v - sum(part) OVER c) / 4, 6) + 0.0 AS v FROM parts WINDOW c AS (PARTITION BY t, ix, iy)""")
def raster_disaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(adapters.epoch(F.col("ts")).alias("s"), (F.col("event_id") % 2).cast("int").alias("ix"), F.lit(0).alias("iy"), "value")
    hourly = e.groupBy((F.floor(F.col("s") / 3600) * 3600 + 3600).cast("long").alias("t"), "ix", "iy").agg(adapters.exact_sum(F.col("value")).alias("v"))
    proxy = e.groupBy((F.floor(F.col("s") / 300) * 300).cast("long").alias("t"), "ix", "iy").agg(F.count("*").cast("double").alias("v"))
    return r6(raster.disaggregate_hours(hourly, proxy, 4, 300), "v").withColumn("v", F.col("v") + 0.0)  # no negative zeros


@query(f"""WITH {CUBE}, data AS (SELECT * FROM cube WHERE v IS NOT NULL), asked AS (SELECT ix, iy, t + 600 AS t FROM cube),
a AS (SELECT q.ix, q.iy, q.t, p.t AS pt, p.v AS pv FROM asked q ASOF LEFT JOIN data p ON q.ix = p.ix AND q.iy = p.iy AND q.t >= p.t),
b AS (SELECT a.*, n.t AS nt, n.v AS nv FROM a ASOF LEFT JOIN data n ON a.ix = n.ix AND a.iy = n.iy AND a.t <= n.t)
SELECT ix, iy, t, round(CASE WHEN pt = nt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 6) AS v FROM b""")
def interpolate_shift_600s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(temporal.interpolate_at(adapters.cube(spark, sf_dir)), "v")


@query("""WITH daily AS (SELECT user_id % 50 AS station, ts::DATE AS date, avg(value) AS v FROM events GROUP BY 1, 2),
calendar AS (SELECT station, d::DATE AS date FROM (SELECT DISTINCT station FROM daily), range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) r(d)),
filled AS (SELECT station, date, v FROM calendar LEFT JOIN daily USING (station, date)),
trimmed AS (SELECT f.* FROM filled f JOIN (SELECT station, min(date) AS lo, max(date) AS hi FROM daily WHERE v IS NOT NULL GROUP BY station) USING (station) WHERE date BETWEEN lo AND hi),
known AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY station ORDER BY date) AS p, min(CASE WHEN v IS NOT NULL THEN date END) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM trimmed)
SELECT k.station, k.date::VARCHAR AS date, round(CASE WHEN k.v IS NOT NULL THEN k.v ELSE a.v + (b.v - a.v) * (k.date - k.p) / (k.q - k.p) END, 6) AS v
FROM known k JOIN daily a ON a.station = k.station AND a.date = k.p JOIN daily b ON b.station = k.station AND b.date = k.q""")
def gapfill_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    daily = e.groupBy((F.col("user_id") % 50).alias("station"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    filled = temporal.gap_fill(daily, ("station",), F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return r6(temporal.interpolate(temporal.trim(filled, "v", ("station",)), "v", F.unix_date("date"), ("station",)), "v").withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {CUBE} SELECT t, ix, iy, nullif(v, 0) AS v, CASE WHEN v = 0 THEN 1 WHEN v > 0 AND v <= 0.1 THEN 1 WHEN v > 0.1 AND v <= 0.2 THEN 2 WHEN v > 0.2 AND v <= 0.5 THEN 3
  WHEN v > 0.5 AND v <= 1 THEN 4 WHEN v > 1 AND v <= 2 THEN 5 WHEN v > 2 AND v <= 5 THEN 6 WHEN v > 5 AND v <= 10 THEN 7 WHEN v > 10 AND v <= 15 THEN 8 WHEN v > 15 AND v <= 25 THEN 9
  WHEN v > 25 AND v <= 40 THEN 10 WHEN v > 40 AND v <= 60 THEN 11 WHEN v > 60 AND v <= 80 THEN 12 WHEN v > 80 THEN 13 END::INT AS class FROM cube""")
def reclassify_colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = adapters.cube(spark, sf_dir)
    return cube.transparent(data.withColumn("class", raster.classify(F.col("v")))).select("t", "ix", "iy", "v", "class")


@query(f"""WITH {CUBE}, target AS (SELECT a.i::INT AS tx, b.i::INT AS ty, floor((a.i + 0.5) * 16 / 10)::INT AS ix, floor((b.i + 0.5) * 16 / 12)::INT AS iy FROM range(10) a(i), range(12) b(i))
SELECT t, tx, ty, v FROM cube JOIN target USING (ix, iy)""")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resample_nearest(adapters.cube(spark, sf_dir), zonal.UNIT_GRID, Grid(0.0, 16.0, 0.0, 16.0, 10, 12))


@query("""WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (l_partkey * 97 + l_suppkey) % 65536 AS cell FROM lineitem),
bits AS (SELECT *, CASE WHEN cell >= 4096 AND cell < 8192 THEN cell - 4096 ELSE cell END AS c FROM raw)
SELECT cell, count(*) AS n, CASE WHEN min(c) <= 4095 THEN min(c) * 0.1::DOUBLE END AS rw, CASE WHEN min(cell % 256) <= 248 THEN greatest(0, min(cell % 256) * 1.0::DOUBLE / 2 - 32.5) END AS rx FROM bits GROUP BY cell""")
def raster_decode_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 97 + F.col("l_suppkey")) % 65536).alias("cell"))
    counted = raw.groupBy("cell").agg(F.count("*").alias("n"))
    return counted.select("cell", "n", radar.decode_column(F.col("cell"), RADAR["RW"]).alias("rw"), F.when(F.col("cell") % 256 <= 248, radar.decode_column(F.col("cell") % 256, RADAR["RX"])).alias("rx"))


@query(f"""WITH {STATIONS} SELECT station, round(acos(least(1, greatest(-1, sin(radians(51)) * sin(radians(lat)) + cos(radians(51)) * cos(radians(lat)) * cos(radians(lon - 13))))) * 6371, 6) AS dist FROM stations""")
def great_circle_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.stations(spark, sf_dir)
    return r6(s.select("station", scalar.great_circle(F.lit(13.0), F.lit(51.0), F.col("lon"), F.col("lat")).alias("dist")), "dist")


_PLACES = """places AS (SELECT n_nationkey AS id, 11.1::DOUBLE + n_nationkey * 0.19::DOUBLE AS p_lon, 50.1::DOUBLE + (n_nationkey * 7 % 25) * 0.07::DOUBLE AS p_lat, 300.0 AS p_height FROM nation),
near AS (SELECT id, station, round(acos(least(1, greatest(-1, sin(radians(p_lat)) * sin(radians(lat)) + cos(radians(p_lat)) * cos(radians(lat)) * cos(radians(lon - p_lon))))) * 6371, 6) AS dist, height, p_height FROM places, stations)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return adapters.table(spark, sf_dir, "nation").select(n.alias("id"), (11.1 + n * 0.19).alias("lon"), (50.1 + n * 7 % 25 * 0.07).alias("lat"), F.lit(300.0).alias("height"))


def _near(spark: SparkSession, sf_dir: str, radius: float, height: float | None = None) -> DataFrame:
    return r6(stations.distances(_places(spark, sf_dir), adapters.stations(spark, sf_dir), radius, height), "dist")


@query(f"""WITH {STATIONS}, {_PLACES} SELECT id, station, dist, rank FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist)::INT AS rank FROM near WHERE dist <= 120 AND abs(height - p_height) <= 400) WHERE rank <= 5""")
def nearest_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.nearest(_near(spark, sf_dir, 120.0, 400.0), 5).select("id", "station", "dist", "rank")


@query(f"""WITH {STATIONS}, {_PLACES}, tiers AS (SELECT *, CASE WHEN dist <= 10 THEN 1 WHEN dist <= 25 THEN 2 WHEN dist <= 100 THEN 3 END AS tier FROM near)
SELECT id, station, dist, tier::INT AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS least FROM tiers WHERE tier IS NOT NULL) WHERE tier = least""")
def radius_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = stations.tiered(_places(spark, sf_dir), adapters.stations(spark, sf_dir), (10.0, 25.0, 100.0))
    return r6(near, "dist").select("id", "station", "dist", "tier")


@query(f"""WITH {STATIONS}, {_PLACES}, close AS (SELECT id, station, dist FROM near WHERE dist <= 60),
daily AS (SELECT user_id AS station, ts::DATE AS date, avg(value) AS mean, max(value) AS max, min(value) AS min FROM events GROUP BY 1, 2)
SELECT id, date::VARCHAR AS date, round(sum(mean / pow(greatest(dist, 1e-9), 2)) / sum(1 / pow(greatest(dist, 1e-9), 2)), 6) AS mean, round(avg(max), 6) AS max, round(avg(min), 6) AS min
FROM daily JOIN close USING (station) GROUP BY id, date""")
def idw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stations.inverse_distance(stations.daily(adapters.measurements(spark, sf_dir)), _near(spark, sf_dir, 60.0)), "mean", "max", "min").withColumn("date", F.col("date").cast("string"))


@query("""SELECT user_id AS station, (ceil(epoch_us(ts) / 3600000000) * 3600)::BIGINT AS hour, round(avg(value), 6) AS v FROM events GROUP BY 1, 2""")
def hourly_ceil_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(temporal.hourly_mean(adapters.measurements(spark, sf_dir)), "v")


_SPLICE = f"""WITH observed AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS t, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM events GROUP BY 1),
runs AS (SELECT {FIRST_DAY} + 600 + (event_id % 10) * 86400 AS run, (event_id % 28)::INT AS f, max(value) AS v FROM events GROUP BY 1, 2),
seen AS (SELECT t + 600 AS t, v, 'observed' AS kind FROM observed), valid AS (SELECT run + f * 3600 AS t, v, 'forecast' AS kind FROM runs),
joined AS (SELECT * FROM seen UNION ALL SELECT * FROM valid WHERE t NOT IN (SELECT t FROM seen))"""


def _spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    hour = (F.floor(adapters.epoch(F.col("ts")) / 3600) * 3600).cast("long")
    observed = e.groupBy(hour.alias("t")).agg(adapters.exact_sum(F.col("value")).alias("v"))
    runs = e.groupBy((F.lit(FIRST_DAY) + 600 + F.col("event_id") % 10 * DAY).alias("run"), (F.col("event_id") % 28).cast("int").alias("f")).agg(F.max("value").alias("v"))
    return temporal.splice(observed, runs)


@query(_SPLICE + " SELECT t, v, kind FROM joined")
def obs_forecast_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spliced(spark, sf_dir)


@query(_SPLICE + """ SELECT t // 86400 AS day, string_agg(t::VARCHAR, ',' ORDER BY t, v) AS times, count(*) AS n FROM joined GROUP BY 1""")
def comma_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _spliced(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    return temporal.comma_series(days, ("day",)).select("day", "times", (F.size(F.split("vals", ","))).cast("long").alias("n"))


_STARTS = "starts AS (SELECT unnest([0, 1, 5, 17])::BIGINT AS start)"


def _river(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = adapters.catchments(spark, sf_dir)
    links = c.where("next >= 0 and id <> next").select(F.col("id").alias("src"), F.col("next").alias("dst"))
    return c, links, spark.createDataFrame([(0,), (1,), (5,), (17,)], "id bigint")


@query(f"""WITH RECURSIVE {CATCHMENTS}, {_STARTS}, up AS (SELECT start, start AS id, 0 AS hops FROM starts UNION ALL SELECT start, c.id, hops + 1 FROM up JOIN catchments c ON c.next = up.id AND c.id <> c.next) SELECT start, id, hops FROM up""")
def upstream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, starts = _river(spark, sf_dir)
    return graph.upstream(links, starts)


@query(f"""WITH RECURSIVE {CATCHMENTS}, starts AS (SELECT id AS start FROM catchments), down AS (SELECT start, start AS id, 0 AS hops FROM starts UNION ALL SELECT start, c.next, hops + 1 FROM down JOIN catchments c ON c.id = down.id WHERE c.next >= 0) SELECT start, id, hops FROM down""")
def downstream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, links, _ = _river(spark, sf_dir)
    return graph.downstream(links, c.select("id"))


@query(f"""WITH RECURSIVE {CATCHMENTS}, links AS (SELECT id AS src, next AS dst FROM catchments WHERE next >= 0), {_STARTS},
hood AS (SELECT start, start AS id, 0 AS hops FROM starts UNION SELECT h.start, CASE WHEN l.src = h.id THEN l.dst ELSE l.src END, hops + 1 FROM hood h JOIN links l ON h.id IN (l.src, l.dst) WHERE hops < 2),
found AS (SELECT DISTINCT start, id FROM hood)
SELECT a.start, l.src, l.dst FROM links l JOIN found a ON a.id = l.src JOIN found b ON b.id = l.dst AND b.start = a.start""")
def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, starts = _river(spark, sf_dir)
    return graph.neighbourhood(links, starts, "all", 2)


@query(f"""WITH RECURSIVE {CATCHMENTS}, {_STARTS}, up AS (SELECT start, start AS id FROM starts UNION ALL SELECT start, c.id FROM up JOIN catchments c ON c.next = up.id AND c.id <> c.next)
SELECT start AS id, count(*) AS n, round(sum(area_sqkm), 6) AS area_sqkm FROM up JOIN catchments USING (id) GROUP BY start""")
def upstream_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, links, starts = _river(spark, sf_dir)
    return r6(graph.upstream_area(c, links, starts), "area_sqkm")


@query(f"""WITH RECURSIVE {OVERLAP}, {CUBE}, up AS (SELECT 0::BIGINT AS id UNION ALL SELECT n_nationkey FROM up JOIN nation ON n_nationkey // 2 = up.id AND n_nationkey > 0),
basin AS (SELECT ix, iy, least(1, sum(weight)) AS weight, 1.0::DOUBLE AS size FROM overlap JOIN up USING (id) GROUP BY ix, iy), normed AS (SELECT *, weight / sum(weight) OVER () AS weight_norm, sum(weight * size) OVER () AS area FROM basin)
SELECT t, round(coalesce(sum(v * weight_norm), 0), 6) AS mean, max(v) AS max, min(v) AS min, round(coalesce(sum(v * weight_norm), 0) * any_value(area), 6) AS sum FROM cube JOIN normed USING (ix, iy) GROUP BY t HAVING min(v) IS NOT NULL""")
def basin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = adapters.boxes(spark, sf_dir)
    n = F.col("n_nationkey")
    links = adapters.table(spark, sf_dir, "nation").where(n > 0).select(n.cast("long").alias("src"), F.floor(n / 2).alias("dst"))
    out = app.basin_series(adapters.cube(spark, sf_dir), zonal.overlap_boxes(boxes), links, spark.createDataFrame([(0,)], "id bigint"))
    return r6(out.select("t", "mean", "max", "min", "sum"), "mean", "sum")


@query("""WITH cells AS (SELECT c_custkey::VARCHAR AS own, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE (c_custkey // 2)::VARCHAR || ',' || (c_custkey // 3)::VARCHAR END AS conn FROM customer)
SELECT DISTINCT own AS src, trim(unnest(string_split(conn, ','))) AS dst FROM cells WHERE conn <> 'none'""")
def graph_multi_valued_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    conn = F.when(k % 5 == 0, "none").otherwise(F.concat_ws(",", F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")))
    return graph.edges(adapters.table(spark, sf_dir, "customer").select(k.alias("id"), conn.alias("conn")), "id", out_col="conn", none="none")


@query("""SELECT c_nationkey AS id, CASE WHEN count(v) = count(*) THEN round(sum(v * area) / sum(area), 6) END AS avg FROM (
  SELECT c_nationkey, CASE WHEN c_custkey % 41 <> 0 THEN c_acctbal END AS v, 1.0 + c_custkey % 7 AS area FROM customer) GROUP BY c_nationkey""")
def area_weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = adapters.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.when(k % 41 != 0, F.col("c_acctbal")).alias("v"), (1.0 + k % 7).alias("area"))
    return r6(stations.area_weighted(parts, ("id",)), "avg")


@query("""WITH g AS (SELECT c_nationkey AS id, round(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + c_custkey % 7 END) / sum(1.0::DOUBLE + c_custkey % 7), 6) AS missing FROM customer GROUP BY 1)
SELECT id, missing, CASE WHEN missing > 0.5 THEN 'error' WHEN missing > 0.25 THEN 'warn' ELSE 'ok' END AS status FROM g""")
def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = adapters.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), (1.0 + F.col("c_custkey") % 7).alias("area"), F.col("c_mktsegment").alias("s"))
    return r6(stations.coverage_gate(parts, F.col("s").isin("BUILDING", "MACHINERY")), "missing")


@query(f"""WITH {CUBE} SELECT v, (16 - iy)::INT AS row, (ix + 1)::INT AS col, t FROM cube WHERE v IS NOT NULL""")
def melt_sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.melt_sparse(adapters.cube(spark, sf_dir), zonal.UNIT_GRID)


@query("""SELECT user_id AS station, date_trunc('hour', ts)::TIMESTAMP AS ts, min(value) AS v FROM events GROUP BY 1, 2""")
def dedup_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.measurements(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return stations.deduplicate(m)


@query("""SELECT user_id AS station, event_type AS phenomenon, max(ts) AS max_time, count(*) AS n FROM events GROUP BY 1, 2""")
def station_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.freshness(adapters.measurements(spark, sf_dir))


_DOY = "(p_partkey % 366 + 1)"


@query("""SELECT p_partkey AS id, round(611.2 * exp(17.62 * t / (t + 243.12)) * rh * 0.001, 9) AS kpa FROM (SELECT p_partkey, p_partkey % 50 - 15.0 AS t, (p_partkey % 11) / 10.0 AS rh FROM part)""")
def vapor_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.table(spark, sf_dir, "part").select(k.alias("id"), F.round(scalar.vapor_pressure(k % 50 - 15.0, k % 11 / 10.0), 9).alias("kpa"))


_T = "(SELECT p_partkey AS id, (p_partkey % 50 - 15.0)::DOUBLE AS t, (p_partkey % 366 + 1)::DOUBLE AS doy, radians(48 + p_partkey % 7) AS lat, radians(p_partkey % 31) AS slope, radians(p_partkey % 360) AS aspect, (p_partkey % 13)::DOUBLE AS d FROM part)"


def _hydro(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return adapters.table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 50 - 15.0).alias("t"), (k % 366 + 1).cast("double").alias("doy"), F.radians(48 + k % 7).alias("lat"), F.radians(k % 31).alias("slope"), F.radians(k % 360).alias("aspect"), (k % 13).cast("double").alias("d")
    )


@query(f"""SELECT id, round(CASE WHEN t < 0 THEN 0.61078 * exp(21.87456 * t / (t + 265.5)) ELSE 0.61078 * exp(17.26939 * t / (t + 237.3)) END, 9) AS es,
  round(CASE WHEN t < 0 THEN 5808 * 0.61078 * exp(21.87456 * t / (t + 265.5)) / pow(t + 265.5, 2) ELSE 4098 * 0.61078 * exp(17.26939 * t / (t + 237.3)) / pow(t + 237.3, 2) END, 9) AS delta FROM {_T}""")
def esat(spark: SparkSession, sf_dir: str) -> DataFrame:
    es, delta = hydro.esat(F.col("t"))
    return _hydro(spark, sf_dir).select("id", F.round(es, 9).alias("es"), F.round(delta, 9).alias("delta"))


@query(f"""SELECT id, round(((50 + d) * 0.1 * (100 + 5 * d) + 1240 * d / 10) / ((0.1 + 0.067) * (50 + d) + 0.067 * (20 + d)), 6) AS le FROM {_T}""")
def penman_monteith(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    le = hydro.penman_monteith(100 + 5 * d, d / 10, F.lit(0.1), 50 + d, 20 + d)
    return _hydro(spark, sf_dir).select("id", F.round(le, 6).alias("le"))


@query(f"""SELECT id, CASE WHEN t - d >= -0.5 THEN 0.0 WHEN t + d < -0.5 THEN 1.0 ELSE round(1 - (t + d + 0.5) / (2 * d), 6) END::DOUBLE AS frac FROM {_T}""")
def snofrac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hydro(spark, sf_dir).select("id", F.round(hydro.snow_fraction(F.col("t") + F.col("d"), F.col("t") - F.col("d")), 6).alias("frac"))


_SUN = f"""sun AS (SELECT *, 1367 / pow(1 - 0.0167 * cos(0.0172 * (doy - 3)), 2) AS scd, asin(0.39785 * sin(4.868961 + 0.017203 * doy + 0.033446 * sin(6.224111 + 0.017202 * doy))) AS dec FROM {_T}),
halves AS (SELECT *, acos(least(1, greatest(-1, -tan(dec) * tan(lat)))) AS half, asin(cos(slope) * sin(lat) + sin(slope) * cos(lat) * cos(aspect)) AS l1,
  atan(sin(slope) * sin(aspect) / (cos(slope) * cos(lat) - sin(slope) * sin(lat) * cos(aspect))) AS l2 FROM sun),
owns AS (SELECT *, acos(least(1, greatest(-1, -tan(dec) * tan(l1)))) AS own FROM halves),
edges AS (SELECT *, least(half, own - l2 + turn) AS t3, greatest(-half, -own - l2 + turn) AS t2,
  0.0864 * scd * (sin(dec) * sin(lat) * 2 * half + cos(dec) * cos(lat) * 2 * sin(half)) / (2 * 3.14159) AS i0h FROM owns, (VALUES (-2 * 3.1416), (0.0), (2 * 3.1416)) turns(turn))"""


@query(f"""WITH {_SUN} SELECT id, round(least(0.9999, greatest(0.0001, any_value(half) / 3.1416)), 6) AS daylen, round(any_value(i0h), 6) AS i0h,
  round(sum(CASE WHEN t3 <= t2 THEN 0 ELSE 0.0864 * scd * (sin(dec) * sin(l1) * (t3 - t2) + cos(dec) * cos(l1) * (sin(t3 + l2) - sin(t2 + l2))) / (2 * 3.14159) / cos(slope) END) / any_value(i0h), 6) AS slfday FROM edges GROUP BY id""")
def sunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    daylen, i0h = hydro.flat_sun(F.col("lat"), F.col("doy"))
    slf = hydro.slope_factor(F.col("lat"), F.col("doy"), F.col("slope"), F.col("aspect"))
    return _hydro(spark, sf_dir).select("id", F.round(daylen, 6).alias("daylen"), F.round(i0h, 6).alias("i0h"), F.round(slf, 6).alias("slfday"))


@query(f"""WITH x AS (SELECT *, 1.24 * pow((0.5 + d / 20) * 10 / (t + 273.15), 1 / 7.0::DOUBLE) AS e, 0.2 + 0.8 * least(1, greatest(0, (d / 13 - 0.25) / 0.5)) AS c FROM {_T}),
y AS (SELECT *, 0.8 * (200 + 10 * d) + (e - 1) * c * 5.67e-8 * pow(t + 273.15, 4) AS rn FROM x)
SELECT id, round(rn, 6) AS aa, round(rn * exp(-0.6 * (3 + d / 10)), 6) AS asubs FROM y""")
def availen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    aa, asubs = hydro.available_energy(200 + 10 * d, F.lit(0.2), 0.5 + d / 20, F.col("t"), d / 13, F.lit(0.0), F.lit(0.6), F.lit(3.0), d / 10)
    return _hydro(spark, sf_dir).select("id", F.round(aa, 6).alias("aa"), F.round(asubs, 6).alias("asubs"))


_ROUGH = f"""x AS (SELECT *, 0.3 + d * 2 AS h, d / 3 AS lai, d / 15 AS sai FROM {_T}),
y AS (SELECT *, CASE WHEN h >= 10 THEN 0.05 * h WHEN h <= 1 THEN 0.13 * h ELSE 0.13 + (0.5 - 0.13) * (h - 1) / 9 END AS z0c FROM x),
z AS (SELECT *, h - z0c / 0.3 AS dispc, least(0.02, z0c) AS z0gs, (lai + sai) / (4 + 0.035 * h) AS ratio FROM y),
w AS (SELECT *, ratio * pow(-1 + exp(0.909 - 3.03 * z0c / h), 4) AS xx FROM z),
v AS (SELECT *, CASE WHEN ratio >= 1 THEN dispc ELSE 1.1 * h * ln(1 + pow(xx, 0.25)) END AS disp FROM w),
rough AS (SELECT *, CASE WHEN ratio >= 1 THEN z0c ELSE least(0.3 * (h - disp), z0gs + 0.3 * h * sqrt(xx)) END AS z0, h + 2 AS za FROM v)"""


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _hydro(spark, sf_dir).withColumn("h", 0.3 + F.col("d") * 2).withColumn("lai", F.col("d") / 3).withColumn("sai", F.col("d") / 15)
    return base.select("*", *[c.alias(k) for k, c in hydro.roughness(F.col("h"), F.col("lai"), F.col("sai"), F.lit(0.02)).items()])


@query(f"""WITH {_ROUGH} SELECT id, round(z0gs, 6) AS z0gs, round(z0c, 6) AS z0c, round(dispc, 6) AS dispc, round(z0, 6) AS z0, round(disp, 6) AS disp, round(za, 6) AS za FROM rough""")
def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("z0gs", "z0c", "dispc", "z0", "disp", "za")
    return r6(_rough(spark, sf_dir).select("id", *names), *names)


@query(f"""WITH {_ROUGH} SELECT id, round(ln(0.334 * pow(5000, 0.875) * pow(0.005, 0.125) / 0.005) * ln((za - disp) / z0) / (ln(0.334 * pow(5000, 0.875) * pow(0.005, 0.125) / z0) * ln(2000)), 6) AS adj FROM rough""")
def wndadj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rough(spark, sf_dir).select("id", F.round(hydro.wind_adjustment(F.col("za"), F.col("disp"), F.col("z0")), 6).alias("adj"))


@query(f"""WITH x AS (SELECT *, (2 * (1 + d) + d / 10) / (2 * (1 + d)) AS fs FROM {_T}), y AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE ((1000 + 125) / (1000 * 0.6 * fs)) * ln((125 + 0.6 * 40 * d) / (125 + 0.6 * 40 * d * exp(-0.6 * fs * (1 + d)))) END AS light,
  CASE WHEN t <= 0 THEN 0 WHEN t < 10 THEN 1 - pow((10 - t) / 10, 2) WHEN t <= 30 THEN 1 ELSE 0 END AS warm FROM x)
SELECT id, round(1 / (1 / (1 + d / 20) * warm * light * (0.0053 - 0.0003) + (1 + d) * 0.0003), 6) AS rsc FROM (SELECT *, 1 AS one FROM y)""")
def srsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    rsc = hydro.canopy_resistance(40 * d, F.col("t"), d / 10, 1 + d, d / 10, 0.0003, F.lit(0.0053), F.lit(0.6))
    return _hydro(spark, sf_dir).select("id", F.round(rsc, 6).alias("rsc"))


@query(f"""WITH x AS (SELECT *, (t + d + t - d) / 2 AS ta, 0.25 + d / 26 AS dl FROM {_T})
SELECT id, round(CASE WHEN d < 0.001 THEN 0.55 * 9 WHEN d > 9 THEN 0.99 * 9 ELSE d END, 6) AS solradc, round(ta + (2 * d / (2 * 3.1416 * dl)) * sin(3.1416 * dl), 6) AS tadtm,
  round(ta - (2 * d / (2 * 3.1416 * (1 - dl))) * sin(3.1416 * dl), 6) AS tantm, round(greatest(0.2, CASE WHEN d = 0 THEN 0.1 ELSE d / 30 END) / (dl + (1 - dl) * 0.3), 6) AS uadtm FROM x""")
def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = F.col("t"), F.col("d")
    out = hydro.day_night(d, F.lit(9.0), t + d, t - d, F.lit(0.8), d / 30, 0.25 + d / 26, F.lit(1.0))
    return _hydro(spark, sf_dir).select("id", *[F.round(out[k], 6).alias(k) for k in ("solradc", "tadtm", "tantm", "uadtm")])


@query(f"""WITH x AS (SELECT id, -5.0 - d AS psif, 0.2 + d / 100 AS thetaf, 0.45::DOUBLE AS thsat, 4.0 + d / 2 AS bexp, 0.92::DOUBLE AS wetinf, 3.0 + d AS kf FROM {_T}),
y AS (SELECT *, thetaf / thsat AS wetf FROM x), z AS (SELECT *, psif * pow(wetinf / wetf, -bexp) AS psiinf FROM y),
w AS (SELECT *, -psiinf / pow(1 - wetinf, 2) + bexp * psiinf / (wetinf * (1 - wetinf)) AS chm FROM z)
SELECT id, round(wetf, 6) AS wetf, round(psiinf, 6) AS psiinf, round(chm, 6) AS chm, round(2 * wetinf - 1 + psiinf * bexp / (chm * wetinf), 6) AS chn, round(kf * pow(1 / wetf, 2 * bexp + 3), 4) AS ksat, round(wetf * pow(-2000 / psif, -1 / bexp), 6) AS wetc FROM w""")
def soilpar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    out = hydro.soil_constants(-5.0 - d, 0.2 + d / 100, F.lit(0.45), 4.0 + d / 2, F.lit(0.92), 3.0 + d)
    return _hydro(spark, sf_dir).select("id", *[F.round(c, 4 if k == "ksat" else 6).alias(k) for k, c in out.items()])


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of five catchments (regions) by land cover and soil, and their weather: the tables' days, shifted by region."""
    covers = ["Coniferous Forest", "Grass Land", "Cultivated", "Deciduous Forest"]
    layer = spark.createDataFrame(
        [(s, i, 0.1 + 0.05 * i, 0.05 * s, -5.0 - s, 0.25 + 0.02 * s, 0.42 + 0.01 * s, 4.5 + s, 5.0 + s, 0.92) for s in range(2) for i in range(5)],
        "soil string, layer int, thick double, stonef double, psif double, thetaf double, thsat double, bexp double, kf double, wetinf double",
    )
    n = F.col("n_nationkey")
    own = adapters.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("catchment"), F.element_at(F.array(*[F.lit(c) for c in covers]), (n % 4 + 1).cast("int")).alias("cover"), (n % 2).cast("string").alias("soil"), (1.0 + n % 3).alias("area")
    )
    own = own.groupBy("catchment", "cover", "soil").agg(F.sum("area").alias("area"))
    terrain = spark.range(5).select(F.col("id").alias("catchment"), (50.5 + F.col("id") * 0.1).alias("latitude"), (1.0 + F.col("id")).alias("slope"))
    days = adapters.weather(spark, sf_dir).crossJoin(F.broadcast(spark.range(5).select(F.col("id").alias("catchment")))).withColumn("precip", F.col("precip") * (1 + F.col("catchment") / 10))
    return brook90.parameters(own, brook90.soil_profile(layer), terrain), brook90.daily_input(days)


@query()
def brook90_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brook90.run(*_runs(spark, sf_dir))


@query()
def brook90_soil_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brook90.catchment_average(brook90.run(*_runs(spark, sf_dir)))


@query(f"""WITH {HOURLY} SELECT t, ix, iy, v FROM cube""")
def ingest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the steps, then all of them twice: the target holds every step once."""
    target = graph.shared_path(spark, "ingest")
    data = adapters.cube(spark, sf_dir, 3600)
    for part in (data.where("t % 7200 = 0"), data, data):
        ingest.update(target, part)
    return spark.read.parquet(target).select("t", "ix", "iy", "v")


@query(f"""WITH {HOURLY} SELECT t, ix, iy, v FROM cube""")
def ingest_split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that arrive in two parts, the second time with the first part again."""
    target = graph.shared_path(spark, "split")
    data = adapters.cube(spark, sf_dir, 3600)
    for part in (data.where("ix < 5"), data.where("ix >= 3")):
        ingest.update(target, part)
    return spark.read.parquet(target).select("t", "ix", "iy", "v")


@query(f"""WITH {HOURLY} SELECT t, ix, iy, CASE WHEN t % 14400 = 0 THEN -v ELSE v END AS v FROM cube""")
def cube_replace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube written in two parts, the second again, and then some steps with other values in the place of theirs."""
    path, staging = (graph.shared_path(spark, n) for n in ("cube", "staging"))
    data = adapters.cube(spark, sf_dir, 3600).select("t", "ix", "iy", "v")
    for part in (data.where("t % 7200 = 0"), data, data):
        cube.append_steps(part, path)
    cube.replace_steps(data.where("t % 14400 = 0").withColumn("v", -F.col("v")), path, staging)
    return spark.read.parquet(path).select("t", "ix", "iy", "v")


@query(f"""WITH {HOURLY} SELECT t, ix, iy, v FROM cube""")
def stream_ingest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over files that arrive in two lots, one of them again."""
    source, target, state = (graph.shared_path(spark, n) for n in ("arrivals", "ingested", "state"))
    data = adapters.cube(spark, sf_dir, 3600)
    for part in (data.where("t % 7200 = 0"), data):
        part.write.mode("append").parquet(source)
        ingest.stream_update(spark, source, "t bigint, ix int, iy int, v double", target, state).awaitTermination()
    return spark.read.parquet(target).select("t", "ix", "iy", "v")


@query(f"""WITH {FORECAST}, whole AS (SELECT run FROM forecast GROUP BY run HAVING count(DISTINCT f) = 7 AND run % 172800 = 0)
SELECT run, f, 0 AS ix, 0 AS iy, round(v - coalesce(lag(v) OVER (PARTITION BY run ORDER BY f), 0), 6) AS v FROM forecast SEMI JOIN whole USING (run)""")
def forecast_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.forecast(spark, sf_dir).withColumn("ix", F.lit(0)).withColumn("iy", F.lit(0))
    there = runs.where("run % 172800 <> 0").select("run")
    return r6(ingest.forecast_update(runs, there, F.lit(7)).select("run", "f", "ix", "iy", "v"), "v")


@query(f"""SELECT id, lon, lat, round(6370.04 * (1 + sin(radians(60))) / (1 + sin(radians(lat))) * cos(radians(lat)) * sin(radians(lon - 10)), 6) AS x,
  round(-6370.04 * (1 + sin(radians(60))) / (1 + sin(radians(lat))) * cos(radians(lat)) * cos(radians(lon - 10)), 6) AS y, true AS returns
FROM (SELECT s_suppkey AS id, 11.0::DOUBLE + (s_suppkey * 37 % 500) / 100.0::DOUBLE AS lon, 50.0::DOUBLE + (s_suppkey * 61 % 200) / 100.0::DOUBLE AS lat FROM supplier)""")
def stereographic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:

    s = adapters.stations(spark, sf_dir).select(F.col("station").alias("id"), "lon", "lat")
    x, y = crs.to_stereographic(F.col("lon"), F.col("lat"))
    lon, lat = crs.from_stereographic(x, y)
    back = (F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9)
    return r6(s.select("id", "lon", "lat", x.alias("x"), y.alias("y"), back.alias("returns")), "x", "y")


# Operators and process functions that no query above runs. Their SQL is written from the published formulas.


@query(f"""WITH {CUBE} SELECT t, max(v) - min(v) AS spread, count(v) AS n, round(avg(v * v), 6) AS square FROM cube GROUP BY t""")
def cube_custom_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fun = {"spread": lambda v: F.max(v) - F.min(v), "n": F.count, "square": lambda v: F.avg(v * v)}
    return r6(cube.statistics(adapters.cube(spark, sf_dir), fun=fun), "square")


@query("""SELECT event_type AS phenomenon, user_id AS station, ts::DATE::VARCHAR AS date, sum(value::DECIMAL(18,2))::DOUBLE AS sum FROM events GROUP BY 1, 2, 3""")
def daily_precipitation_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").select(F.col("event_type").alias("phenomenon"), F.col("user_id").alias("station"), "ts", F.col("value").cast("decimal(18,2)").alias("v"))
    return stations.daily_sum(e, ("phenomenon", "station")).withColumn("date", F.col("date").cast("string")).withColumn("sum", F.col("sum").cast("double"))


@query("""WITH days AS (SELECT DISTINCT ts::DATE AS date FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT d.date::VARCHAR AS date, (SELECT round(avg(value), 6) FROM events WHERE event_type = 'click' AND ts::DATE = d.date) AS click,
  (SELECT round(avg(value), 6) FROM events WHERE event_type = 'view' AND ts::DATE = d.date) AS view,
  (SELECT round(avg(value), 6) FROM events WHERE event_type = 'error' AND ts::DATE = d.date) AS error FROM days d""")
def outer_join_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    means = [e.where(F.col("event_type") == k).groupBy("date").agg(F.round(F.avg("value"), 6).alias(k)) for k in ("click", "view", "error")]
    return temporal.full_outer(means).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {CUBE} SELECT t, ix, iy, a.v * 2 - b.v AS v FROM cube a JOIN (SELECT t - 86400 AS t, ix, iy, v FROM cube) b USING (t, ix, iy)""")
def raster_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = adapters.cube(spark, sf_dir).select("t", "ix", "iy", "v")
    return raster.algebra(data, data.withColumn("t", F.col("t") - DAY), lambda v, w: v * 2 - w)


@query(f"""WITH {OVERLAP}, terrain AS (SELECT ix, iy, sqrt(1 + ix * 7 % 5 + iy) AS v FROM cells) SELECT id, round(sum(v * weight) / sum(weight), 6) AS z FROM overlap JOIN terrain USING (ix, iy) GROUP BY id""")
def height_under_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(256).select((F.col("id") % 16).cast("int").alias("ix"), F.floor(F.col("id") / 16).cast("int").alias("iy"))
    terrain = cells.withColumn("v", F.sqrt(1 + F.col("ix") * 7 % 5 + F.col("iy")))
    return r6(zonal.height_under(zonal.overlap_boxes(adapters.boxes(spark, sf_dir)), terrain), "z")


@query("""SELECT c_custkey AS id, (1700000000 + c_custkey * 977 - 2 * 32140800) // 86400 * 86400 + 3600 AS t0, 1700000000 + c_custkey * 977 + 3600 AS t1 FROM customer""")
def simulation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t0, t1 = temporal.model_window(1_700_000_000 + k * 977, 2)
    return adapters.table(spark, sf_dir, "customer").select(k.alias("id"), t0.alias("t0"), t1.alias("t1"))


@query(f"""SELECT id, round(CASE WHEN doy <= 40 THEN 0.3 WHEN doy < 140 THEN 0.3 + (doy - 40) / 100 * 0.7 WHEN doy < 260 THEN 1.0 WHEN doy < 330 THEN 1 - (doy - 260) / 70 * 0.6 ELSE 0.4 END, 9)::DOUBLE AS share FROM {_T}""")
def function_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = hydro.at_day(F.col("doy"), [40.0, 0.3, 140.0, 1.0, 260.0, 1.0, 330.0, 0.4])
    return _hydro(spark, sf_dir).select("id", F.round(share, 9).alias("share"))


@query(f"""SELECT id, round(t * 0.0864, 9) AS energy, round_even(d / 4, 0) AS whole, 'x/' || id || '_' || CASE WHEN d = 0 THEN 'none' ELSE 'some' END || '.bin' AS path, CASE WHEN d = 0 THEN 2.5 ELSE d END::DOUBLE AS filled FROM {_T}""")
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scalar.substitute("x/%%id%%_%%kind%%.bin", {"id": F.col("id"), "kind": F.when(F.col("d") == 0, "none").otherwise("some")})
    return _hydro(spark, sf_dir).select(
        "id", F.round(scalar.daily_energy(F.col("t")), 9).alias("energy"), scalar.half_even(F.col("d") / 4).alias("whole"), path.alias("path"), scalar.with_default(F.col("d"), 2.5, True).alias("filled")
    )


@query(f"""WITH {STATIONS} SELECT station, round(lon * pi() / 180 * 6378137, 4) AS x, round(ln((1 + sin(radians(lat))) / cos(radians(lat))) * 6378137, 4) AS y, round(lon, 6)::DOUBLE AS lon, round(lat, 6)::DOUBLE AS lat FROM stations""")
def web_mercator_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = crs.to_web_mercator(F.col("lon").cast("double"), F.col("lat").cast("double"))
    moved = adapters.stations(spark, sf_dir).select("station", x.alias("x"), y.alias("y"))
    lon, lat = crs.from_web_mercator(F.col("x"), F.col("y"))
    return moved.select("station", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""SELECT user_id AS station, epoch_us(ts) // 1000000 AS t, value AS v FROM events""")
def reply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of two lines, values and times, as services send them, read back."""
    e = adapters.table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), adapters.epoch(F.col("ts")).alias("t"), F.col("value").alias("v"))
    replies = temporal.comma_series(e, ("station",)).select("station", F.concat("vals", F.lit("\n"), "times").alias("reply"))
    return replies.select("station", F.explode(temporal.parse_reply(F.col("reply"))).alias("r")).select("station", F.col("r.t").cast("long").alias("t"), "r.v")


@query(f"""WITH {CATCHMENTS} SELECT id, next, area_sqkm FROM catchments WHERE id = 42""")
def vertex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertex(adapters.catchments(spark, sf_dir), "id", F.lit(42))


@query(f"""WITH x AS (SELECT id, 150 + 10 * d AS aa, 20 + d AS asubs, 0.1 + d / 20 AS vpd, 10 + d AS raa, 20 + d AS rac, 30 + d AS ras, 50 + d AS rsc, 200 + 10 * d AS rss, 0.12 AS dl FROM {_T}),
y AS (SELECT *, (dl + 0.067) * ras + 0.067 * rss AS rs, (dl + 0.067) * rac + 0.067 * rsc AS rc, (dl + 0.067) * raa AS ra FROM x),
z AS (SELECT *, (dl * (raa + ras) * aa + 1240 * (vpd - dl * ras * (aa - asubs) / 1240)) / ((dl + 0.067) * (raa + ras) + 0.067 * rss) AS pms, (dl * (raa + rac) * aa + 1240 * (vpd - dl * rac * asubs / 1240)) / ((dl + 0.067) * (raa + rac) + 0.067 * rsc) AS pmc FROM y),
w AS (SELECT *, pmc * rc * (rs + ra) / (rc * (rs + ra) + rs * ra) * ((rc * (rs + ra) + rs * ra) / (rc * (rs + ra))) * (1 / (1 + rc * ra / (rs * (rc + ra)))) + pms / (1 + rs * ra / (rc * (rs + ra))) AS le FROM z),
v AS (SELECT *, vpd + raa * (dl * aa - (dl + 0.067) * le) / 1240 AS d0 FROM w)
SELECT id, round(0.4085 * 0.0864 * (dl * rac * (aa - asubs) + 1240 * d0) / ((dl + 0.067) * rac + 0.067 * rsc), 6) AS prate, round(0.4085 * 0.0864 * (dl * ras * asubs + 1240 * d0) / ((dl + 0.067) * ras + 0.067 * rss), 6) AS erate FROM v""")
def potential_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    p, e = hydro.potential_rates(150 + 10 * d, 20 + d, 0.1 + d / 20, 10 + d, 20 + d, 30 + d, 50 + d, 200 + 10 * d, F.lit(0.12))
    return _hydro(spark, sf_dir).select("id", F.round(p, 6).alias("prate"), F.round(e, 6).alias("erate"))


@query(f"""WITH x AS (SELECT id, (0.12 + 0.067) * (30 + d) + 0.067 * (200 + 10 * d) AS rs, (0.12 + 0.067) * (10 + d) AS ra, d / 5 / (0.4085 * 0.0864) AS lec, 0.12 * (30 + d) * (20 + d) + 0.12 * (10 + d) * (150 + 10 * d) + 1240 * (0.1 + d / 20) AS top FROM {_T})
SELECT id, round(0.4085 * 0.0864 * ((rs * lec + top) / (rs + ra) - lec), 6) AS erate FROM x""")
def ground_evaporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    e = hydro.ground_evaporation(150 + 10 * d, 20 + d, 0.1 + d / 20, 10 + d, 30 + d, 200 + 10 * d, F.lit(0.12), d / 5)
    return _hydro(spark, sf_dir).select("id", F.round(e, 6).alias("erate"))


@query(f"""WITH x AS (SELECT *, 1 + d / 4 AS h, 3 + 2 * d / 10 AS ua, 0.1 * (1 + d / 4) AS z0, 0.6 * (1 + d / 4) AS disp FROM {_T}), y AS (SELECT *, 0.4 * ua / ln((20 - disp) / z0) AS us FROM x), z AS (SELECT *, 0.4 * us * (h - disp) AS kh, us / 0.4 * ln((h - disp) / z0) AS uh FROM y)
SELECT id, round(ln((20 - disp) / (h - disp)) / (0.4 * us) + h / (2.5 * kh) * (exp(2.5 * (h - 0.6 * h - 0.1 * h) / h) - 1), 6) AS raa,
  round(250 * sqrt(0.05 / uh) / (1 - exp(-1.25)) / (2 * (d + 0.5) + 3.1416 * 0.3), 6) AS rac, round(greatest(1, h * exp(2.5) / (2.5 * kh) * (exp(-2.5 * 0.02 / h) - exp(-2.5 * 0.7 * h / h))), 6) AS ras FROM z""")
def aerodynamic_resistances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    h = 1 + d / 4
    r = hydro.aerodynamics(3 + 2 * d / 10, F.lit(20.0), h, 0.1 * h, 0.6 * h, 0.1 * h, 0.6 * h, F.lit(0.02), F.lit(0.05), d + 0.5, F.lit(0.3))
    return _hydro(spark, sf_dir).select("id", *[F.round(r[k], 6).alias(k) for k in ("raa", "rac", "ras")])


@query(f"""SELECT id, round(0.3 * 0.0864 / 2.824 * 1240 / 0.067 * (CASE WHEN -d > -0.1 THEN 0.61 ELSE 0.61078 * exp(21.87456 * least(t, -d) / (least(t, -d) + 265.5)) END - 0.4) / (30 + d), 6) AS psnvp FROM {_T}""")
def snow_evaporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _hydro(spark, sf_dir).select("id", F.round(hydro.snow_evaporation(-d, F.col("t"), F.lit(0.4), 10 + d, F.lit(20.0), F.lit(0.3)), 6).alias("psnvp"))


@query(f"""SELECT id, round(0.9 * 0.2 * d, 6)::DOUBLE AS flow, round(0.1 * 0.2 * d, 6)::DOUBLE AS seep, round(0.75 * d / 3, 6) AS through, round(0.25 * d / 3, 6) AS past FROM {_T}""")
def ground_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    flow, seep = hydro.ground_water(d, 0.2, 0.1, F.lit(0.0))
    through, past = hydro.ground_water(d, 0.0, 0.25, d / 3)
    return _hydro(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for c, n in ((flow, "flow"), (seep, "seep"), (through, "through"), (past, "past"))])


@query(f"""WITH x AS (SELECT id, 0.15 * d / 2 + 0.15 * 0.5 AS cap, (0.06 * d / 2 + 0.06 * 0.5) * 20 AS most, 1.0 + t / 50 AS pot, 0.05 AS store FROM {_T})
SELECT id, round(CASE WHEN store + most - pot <= 0 THEN most WHEN store + most - pot > cap THEN pot + cap - store ELSE most END, 6) AS caught, round(CASE WHEN store + most - pot > 0 THEN pot ELSE store + most END, 6) AS evaporated FROM x""")
def canopy_interception(spark: SparkSession, sf_dir: str) -> DataFrame:
    caught, evaporated = hydro.interception(F.lit(20.0), 1 + F.col("t") / 50, F.lit(0.05), F.col("d") / 2, F.lit(0.5), 0.06, 0.06, 0.15, 0.15, F.lit(1.0))
    return _hydro(spark, sf_dir).select("id", F.round(caught, 6).alias("caught"), F.round(evaporated, 6).alias("evaporated"))


@query(f"""WITH s AS (SELECT id, d / 12 AS w, -8.5 AS f, 5.0 AS b, 0.92 AS wi, 0.7 AS wf FROM {_T}), p AS (SELECT *, f * pow(wi / wf, -b) AS pi FROM s),
c AS (SELECT *, -pi / pow(1 - wi, 2) + b * pi / (wi * (1 - wi)) AS m, 2 * wi - 1 + pi * b / ((-pi / pow(1 - wi, 2) + b * pi / (wi * (1 - wi))) * wi) AS n FROM p)
SELECT id, CASE WHEN w <= 0 THEN -1e10 WHEN w < wi THEN round(f / pow(w / wf, b), 6) WHEN w < 1 THEN round(m * (w - n) * (w - 1), 6) ELSE 0 END::DOUBLE AS psi,
  CASE WHEN w <= 0 THEN 0 WHEN w < wi THEN round(-b * f / w / pow(w / wf, b), 6) WHEN w < 1 THEN round(m * (2 * w - n - 1), 6) ELSE 0 END::DOUBLE AS slope FROM c""")
def matric_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, f, b, wi, wf = F.col("d") / 12, F.lit(-8.5), F.lit(5.0), F.lit(0.92), F.lit(0.7)
    c = hydro.soil_constants(f, F.lit(0.35), F.lit(0.5), b, wi, F.lit(6.0))
    psi, slope = (g(w, f, b, wi, wf, c["chm"], c["chn"]) for g in (hydro.matric_potential, hydro.potential_slope))
    return _hydro(spark, sf_dir).select("id", F.round(psi, 6).alias("psi"), F.when(w <= 0, 0.0).otherwise(F.round(slope, 6)).alias("slope"))


@query(f"""SELECT id, CASE WHEN abs(-d + 0.5 * t) < 0.01 THEN 0 ELSE round((-d + 0.5 * t) / 80 * least(sqrt((2 + d) * 3), 6, 5) / 0.00981 * 0.85, 6) END::DOUBLE AS vertical,
  round(greatest(0, (2 + d) * 100 * 0.9 * (0.00981 * sin(0.2) + 2 * (-d) / 50000 * cos(0.2)) / (0.00981 * 50000 * cos(0.2))), 9)::DOUBLE AS along FROM {_T}""")
def soil_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, one = F.col("d"), F.lit
    down = hydro.vertical_flow(2 + d, one(3.0), one(6.0), one(5.0), one(100.0), one(80.0), -d, -0.5 * F.col("t"), one(0.1), one(0.2))
    along = hydro.downslope_flow(2 + d, 0.2, 50_000.0, one(100.0), one(0.1), -d)
    return _hydro(spark, sf_dir).select("id", F.round(down, 6).alias("vertical"), F.round(along, 9).alias("along"))


@query(f"""WITH {BOXES}, points AS (SELECT s_suppkey AS pid, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS station, (s_suppkey * 37 % 160) / 10.0::DOUBLE + 0.03 AS x, (s_suppkey * 61 % 160) / 10.0::DOUBLE + 0.03 AS y FROM supplier),
known AS (SELECT s_suppkey AS station, min(s_nationkey) AS id FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT pid, coalesce(any_value(known.id), min(CASE WHEN points.station IS NULL THEN boxes.id END))::INT AS id FROM points LEFT JOIN known ON known.station = points.station
  LEFT JOIN boxes ON x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY pid""")
def catchment_of_station_or_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("s_suppkey"), adapters.table(spark, sf_dir, "supplier")
    asked = s.select(k.alias("pid"), F.when(k % 3 == 0, k).alias("station"), (k * 37 % 160 / 10 + 0.03).alias("x"), (k * 61 % 160 / 10 + 0.03).alias("y"))
    known = s.where("s_acctbal > 0").select(k.alias("station"), F.col("s_nationkey").alias("id"))
    return app.catchment_ids(asked, zonal.box_rings(adapters.boxes(spark, sf_dir)), known, strict=False).withColumn("id", F.col("id").cast("int"))


@query(f"""WITH {CUBE}, cells AS (SELECT DISTINCT ix, iy, (ix * ix + iy) % 3 AS id FROM cube),
pairs AS (SELECT a.id, count(*) AS n FROM cells a JOIN cells b ON a.id = b.id AND ((b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)) GROUP BY a.id)
SELECT id, count(*)::DOUBLE AS area, (4 * count(*) - 2 * coalesce(any_value(n), 0))::DOUBLE AS border FROM cells LEFT JOIN pairs USING (id) GROUP BY id""")
def merged_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = adapters.cube(spark, sf_dir).select("ix", "iy").distinct().withColumn("cell", F.col("iy") * 16 + F.col("ix"))
    boxes = cells.select(F.col("cell").alias("id"), F.col("ix").alias("xmin"), (F.col("ix") + 1).alias("xmax"), F.col("iy").alias("ymin"), (F.col("iy") + 1).alias("ymax"))
    boxes = boxes.select("id", *[F.col(c).cast("double") for c in boxes.columns[1:]])
    merged = zonal.merged_outline(zonal.box_rings(boxes), cells.select(F.col("cell").alias("id"), ((F.col("ix") * F.col("ix") + F.col("iy")) % 3).alias("group")))
    rings = merged.select("id", F.explode("rings").alias("ring"))
    return rings.groupBy("id").agg(F.sum(zonal.signed_area(F.col("ring"))).alias("area"), F.sum(zonal.ring_length(F.col("ring"))).alias("border"))


@query(f"""WITH {HOURLY} SELECT t, ix, iy, v FROM cube WHERE t BETWEEN {FIRST_DAY} + 3000 AND epoch(TIMESTAMP '2024-01-20 09:50:00')""")
def radar_year_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived, folder, now = adapters.cube(spark, sf_dir, 3600), graph.shared_path(spark, "radar"), datetime(2024, 1, 20, 10, 30)
    for _ in range(2):
        app.update_radar_year(folder, RADAR["RW"], arrived, now)
    return spark.read.parquet(f"{folder}/RW").select("t", "ix", "iy", "v")


@query(f"""WITH {FORECAST} SELECT run, h.h::INT AS f, round(v, 6) AS v FROM forecast, range(28) h(h)
WHERE f = 1 AND (run // 86400) % 2 = 0 AND run BETWEEN epoch(TIMESTAMP '1995-01-01') AND epoch(TIMESTAMP '1995-07-01')""")
def forecast_year_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, folder = F.col("h"), graph.shared_path(spark, "forecasts")
    totals = adapters.forecast(spark, sf_dir).where("f = 1").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(27))))
    arrived = totals.where((h < 27) | (F.floor(F.col("run") / DAY) % 2 == 0)).select("run", h.alias("f"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), (F.col("v") * (h + 1)).alias("v"))
    for _ in range(2):
        app.update_forecast_year(folder, FORECASTS["tot_prec"], arrived, datetime(1995, 7, 1))
    return r6(spark.read.parquet(f"{folder}/tot_prec").select("run", "f", "v"), "v")


@query(f"""WITH {CUBE} SELECT t, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM cube
WHERE ix BETWEEN 1 AND 9 AND iy BETWEEN 4 AND 14 AND t BETWEEN epoch(TIMESTAMP '2023-12-30') AND epoch(TIMESTAMP '2024-01-12') GROUP BY t HAVING min(v) IS NOT NULL""")
def stored_radar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = graph.shared_path(spark, "cube")
    cube.write_cube(adapters.cube(spark, sf_dir), path)
    return r6(app.radar_series(spark, path, datetime(2023, 12, 30), datetime(2024, 1, 12), box=(1, 9, 4, 14)), "mean").select("t", "mean", "min", "max")


@query("""SELECT s_nationkey AS reply_of, s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal > 0 THEN 'A & ' || s_name END AS name, 3 AS points, s_suppkey + 0.5::DOUBLE AS y FROM supplier""")
def wfs_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("<app:name>A &amp; "), "s_name", F.lit("</app:name>"))).otherwise("")
    ring = F.concat(F.lit("<app:shape><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList srsDimension='2'>0 0 "), k, F.lit(" "), k, F.lit(".5\n1 1</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></app:shape>"))
    member = F.concat(F.lit("<gml:featureMember><app:basin gml:id='b'><app:id>"), k, F.lit("</app:id>"), name, ring, F.lit("</app:basin></gml:featureMember>"))
    each = adapters.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("reply_of"), member.alias("m"))
    replies = each.groupBy("reply_of").agg(F.concat(F.lit("<wfs:FeatureCollection>"), F.array_join(F.collect_list("m"), "\n"), F.lit("</wfs:FeatureCollection>")).alias("reply"))
    found = services.parse_features(replies, "app:basin", ["id", "name"])
    return found.select("reply_of", "id", "name", F.size(F.col("rings")[0]).alias("points"), F.col("rings")[0][1]["y"].alias("y"))


@query(f"""WITH {BOXES} SELECT id, k::INT AS part, xmin + 20 * k AS xmin, xmax + 20 * k AS xmax, ymin, ymax FROM boxes, range(2) r(k) WHERE k = 0 OR id % 2 = 1""")
def geojson_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda k: F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", *[F.col(c) + (20 * k if c[0] == "x" else 0) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")) for c in (x, y)])
    shape = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"Feature","properties":{{}},"geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit("}}"))
    text = F.when(F.col("id") % 2 == 1, shape("MultiPolygon", F.concat(F.lit("["), box(0), F.lit(","), box(1), F.lit("]")))).otherwise(shape("Polygon", box(0)))
    parts = adapters.boxes(spark, sf_dir).select("id", F.posexplode(services.parse_parts(text)).alias("part", "rings"))
    return parts.select("id", "part", *zonal.bounding_box(F.col("rings")))


@query("""WITH days AS (SELECT ts::DATE AS date, greatest(0, coalesce(avg(CASE WHEN event_type = 'signup' THEN value END) - 100, 0)) / 8 AS precip FROM events GROUP BY 1),
runs AS (SELECT DISTINCT n_regionkey AS catchment, ['Coniferous Forest', 'Grass Land', 'Cultivated', 'Deciduous Forest'][n_nationkey % 4 + 1] AS cover, (n_nationkey % 2)::VARCHAR AS soil FROM nation)
SELECT catchment::BIGINT AS catchment, cover, soil, year(date)::INT AS year, month(date)::INT AS month, count(*) AS days, round(sum(precip * (1 + catchment / 10)), 6) AS precc, true AS closed
FROM runs, days GROUP BY GROUPING SETS ((catchment, cover, soil, year(date), month(date)), (catchment, cover, soil, year(date)), (catchment, cover, soil))""")
def brook90_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precipitation is what the weather has, and what comes in stays or leaves: the largest daily residual is under 0.003 mm."""
    daily = brook90.run(*_runs(spark, sf_dir)).withColumn("off", (F.abs("balerd") >= 0.003).cast("double"))
    out = brook90.totals(daily, ("precc", "off"), ())
    return r6(out.withColumn("closed", F.col("off") == 0).drop("off"), "precc")
