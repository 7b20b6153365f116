"""Edge rules, round trips and invariants on small fixtures."""

import gzip
import io
import tarfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fluvigrid.functions import crs, hydro, scalar
from fluvigrid.operators import cube, graph, raster, stations, temporal, zonal
from fluvigrid.plans import app, brook90, model
from fluvigrid.plans.parameters import LAND_COVER
from fluvigrid.sources import catalog, radar, services, sinks
from fluvigrid.sources.catalog import Grid
from fluvigrid.streaming import ingest


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# cubes


@pytest.fixture(scope="module")
def small(spark):
    data = [(1, 0, 0, 1.0), (1, 1, 0, 3.0), (1, 0, 1, None), (2, 0, 0, None), (2, 1, 0, None), (3, 1, 1, 5.0)]
    return spark.createDataFrame(data, "t long, ix int, iy int, v double")


def test_missing_cells(small):
    stats = {r["t"]: r for r in cube.statistics(small).collect()}
    assert (stats[1]["mean"], stats[1]["sum"], stats[1]["median"]) == (2.0, 4.0, 2.0)
    assert (stats[2]["mean"], stats[2]["min"], stats[2]["sum"]) == (None, None, 0.0)
    assert stats[3]["sd"] is None
    compat = {r["t"]: r for r in cube.statistics(small, compat=True).collect()}
    assert (compat[2]["min"], compat[2]["max"]) == (float("inf"), float("-inf"))
    assert rows(cube.finite(cube.statistics(small)), "t") == [(1,), (3,)]


def test_custom_reducers(small):
    out = cube.statistics(small, fun={"n": F.count, "spread": lambda v: F.max(v) - F.min(v)})
    assert rows(out.where("t = 1"), "n", "spread") == [(2, 2.0)]


def test_empty_cube(spark, small):
    assert cube.statistics(small.where("false")).count() == 0


def test_snap(spark, small):
    asked = spark.createDataFrame([(1, 1, 1), (2, -5, 0), (3, 2, 9), (4, 9, 12)], "id int, t0 long, t1 long")
    found = rows(cube.snap(small.where("t <> 2"), asked), "id", "t")
    assert found == [(1, 1), (3, 1), (3, 3)]


def test_storage(spark, small, tmp_path):
    path = str(tmp_path / "cube")
    cube.write_cube(small, path, attributes={"crs": "longlat"})
    assert cube.attribute(spark, path, "crs") == "longlat" and cube.attribute(spark, path, "none") is None
    assert cube.read_cube(spark, path, (1, 2)).count() == 5
    cube.rechunk(spark, path, path + "2", 2)
    assert rows(spark.read.parquet(path + "2").where("v is not null"), "t", "v") == rows(small.where("v is not null"), "t", "v")


def test_mask_of_missing_step(spark, small):
    overlap = spark.createDataFrame([(7, 0, 0, 1.0, 1.0, 0.5), (7, 1, 0, 1.0, 1.0, 0.5)], "id int, ix int, iy int, weight double, size double, weight_norm double")
    out = {r["t"]: r for r in cube.mask_statistics(small, overlap).collect()}
    assert (out[1]["mean"], out[1]["sum"], out[2]["mean"], out[2]["max"]) == (2.0, 4.0, 0.0, None)


# zones


def test_weights_sum_to_one_and_triangle_area(spark):
    ring = [Row(x=0.0, y=0.0), Row(x=3.0, y=0.0), Row(x=0.0, y=3.0)]
    polys = spark.createDataFrame([(1, [ring]), (2, [[Row(x=5.2, y=5.2), Row(x=5.4, y=5.2), Row(x=5.4, y=5.4), Row(x=5.2, y=5.4)]]), (3, [[Row(x=90.0, y=90.0), Row(x=91.0, y=90.0), Row(x=91.0, y=91.0)]])], f"id int, rings {zonal.RINGS}")
    out = zonal.overlap_polygons(polys).groupBy("id").agg(F.sum("weight").alias("area"), F.sum("weight_norm").alias("one")).collect()
    got = {r["id"]: (round(r["area"], 9), round(r["one"], 9)) for r in out}
    assert got == {1: (4.5, 1.0), 2: (0.04, 1.0)}
    assert rows(polys.where("id = 1").select(zonal.centroid(F.col("rings")).alias("c")).select("c.x", "c.y"), "x", "y") == [(1.0, 1.0)]


def test_hole_is_outside(spark):
    sq = lambda a, b: [Row(x=a, y=a), Row(x=b, y=a), Row(x=b, y=b), Row(x=a, y=b)]
    polys = spark.createDataFrame([(1, [sq(0.0, 6.0), sq(2.0, 4.0)])], f"id int, rings {zonal.RINGS}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0)], "pid int, x double, y double")
    assert rows(zonal.locate(points, polys), "pid", "id") == [(1, 1), (2, None), (3, None)]


# rasters


def test_disaggregation_keeps_totals(spark):
    hourly = spark.createDataFrame([(3600, 0, 0, 12.0), (3600, 1, 0, 6.0), (7200, 0, 0, 5.0)], "t int, ix int, iy int, v double")
    proxy = spark.createDataFrame([(3600 - 300 * k, 0, 0, float(k)) for k in range(12)] + [(7200, 0, 0, 1.0)], "t int, ix int, iy int, v double")
    out = raster.disaggregate_hours(hourly, proxy)
    assert out.count() == 24  # the second hour lacks proxy steps
    assert rows(out.groupBy("ix").agg(F.round(F.sum("v"), 9).alias("v")), "ix", "v") == [(0, 12.0), (1, 6.0)]
    assert {round(r["v"], 9) for r in out.where("ix = 1").collect()} == {0.5}


def test_classes(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (80.0,), (81.0,), (None,), (-1.0,)], "v double").select(raster.classify(F.col("v")).alias("c"))
    assert [r["c"] for r in df.collect()] == [1, 1, 2, 12, 13, None, None]


def test_index_round_trip(spark):
    g = Grid(0.0, 9.0, 0.0, 9.0, 9, 9)
    col, row = raster.cell_position(F.col("id"), 9)
    placed = spark.range(1, 82).select("id", col.alias("c"), row.alias("r"))
    x, y = raster.coordinate(F.col("c"), F.col("r"), g)
    c2, r2 = raster.index(x, y, g)
    assert placed.where((c2 != F.array("c")) | (r2 != F.array("r"))).count() == 0


# radar files


def content(product, cells):
    return b"RW headers" + radar.ETX + np.array(cells, "<u1" if product.bytes == 1 else "<u2").tobytes()


def test_decode_and_scan(spark, tmp_path):
    from dataclasses import replace

    rw = replace(catalog.RADAR["RW"], grid=Grid(0, 2, 0, 2, 2, 2))
    raw = content(rw, [10, 4096 + 20, 4096, 9000])
    grid = radar.decode(raw, rw)
    assert grid[0].tolist() == [1.0, 2.0] and grid[1][0] == 0.0 and np.isnan(grid[1][1])
    rx = replace(catalog.RADAR["RX"], grid=Grid(0, 2, 0, 2, 2, 2))
    assert radar.decode(content(rx, [0, 65, 248, 249]), rx)[0].tolist() == [0.0, 0.0]
    name = rw.file_name(datetime(2017, 10, 7, 14, 50))
    (tmp_path / name).write_bytes(raw)
    (tmp_path / (rw.file_name(datetime(2017, 10, 7, 15, 50)) + ".gz")).write_bytes(gzip.compress(raw))
    with tarfile.open(tmp_path / "more.tar.bz2", "w:bz2") as tar:
        info = tarfile.TarInfo(rw.file_name(datetime(2017, 10, 7, 16, 50)))
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    (tmp_path / "other.txt").write_text("no radar")
    got = radar.read_radar(spark, str(tmp_path), rw)
    assert got.count() == 9 and got.select("t").distinct().count() == 3
    assert rows(got.where("ix = 1 and iy = 0").select("v").distinct(), "v") == [(2.0,)]
    names = spark.createDataFrame([(name,), ("x",)], "f string").select(radar.name_value(F.col("f"), rw).alias("t"))
    assert [r["t"] for r in names.collect()] == [datetime(2017, 10, 7, 14, 50), None]


def test_catalogue(spark):
    assert catalog.radar("RW").latest(datetime(2020, 1, 1, 0, 49)) == datetime(2019, 12, 31, 23, 50)
    assert catalog.radar("RX").latest(datetime(2020, 1, 1, 0, 4)) == datetime(2020, 1, 1)
    assert catalog.FORECAST["tot_prec"].steps(2021)[1] == datetime(2021, 12, 31, 21)
    with pytest.raises(ValueError):
        catalog.radar("ZZ")
    assert catalog.horizon(3) == 45 and catalog.horizon(6) == 27 and catalog.grids(spark).count() == 6


# time


def test_as_of_directions(spark):
    series = spark.createDataFrame([(10,), (20,)], "t long")
    probes = spark.createDataFrame([(5,), (10,), (14,), (15,), (25,)], "t long")
    found = lambda d: [r["found"] for r in temporal.as_of(probes, series, d).orderBy("t").collect()]
    assert found("leq") == [10, 10, 10, 10, 20]
    assert found("geq") == [10, 10, 20, 20, 20]
    assert found("both") == [10, 10, 10, 10, 20]
    with pytest.raises(ValueError):
        temporal.as_of(probes, series, "next")


@pytest.mark.parametrize("slice_s", [1, 7, 1000])
def test_as_of_over_slices(spark, slice_s):
    rng = np.random.default_rng(3)
    steps = [(None if k == 2 else int(k), int(t)) for k, t in zip(rng.integers(0, 3, 60), rng.integers(-80, 80, 60))]
    asked = [(k, t) for k in (0, 1, None, 5) for t in range(-90, 90, 3)]
    series, probes = (spark.createDataFrame(x, "k int, t long") for x in (steps, asked))
    got = {d: {(r.k, r.t): r.found for r in temporal.as_of(probes, series, d, ("k",), slice_s).collect()} for d in ("leq", "geq", "both")}
    for k, t in asked:
        own = sorted({s for j, s in steps if j == k})
        le, ge = [s for s in own if s <= t], [s for s in own if s >= t]
        assert got["leq"][k, t] == (le[-1] if le else own[0] if own else None)
        assert got["geq"][k, t] == (ge[0] if ge else own[-1] if own else None)
        assert got["both"][k, t] == (min(own, key=lambda s: (abs(s - t), s)) if own else None)


def test_snap_over_slices(spark):
    steps = [-9, -2, 3, 4, 11, 30]
    data = spark.createDataFrame([(t,) for t in steps], "t long")
    asked = [(i, a, a + w) for i, (a, w) in enumerate((a, w) for a in range(-15, 35, 4) for w in (0, 3, 20))]
    want = []
    for i, a, b in asked:
        if b >= steps[0] and a <= steps[-1]:
            lo, hi = max([t for t in steps if t <= a], default=steps[0]), min([t for t in steps if t >= b], default=steps[-1])
            want += [(i, t) for t in steps if lo <= t <= hi]
    assert rows(cube.snap(data, spark.createDataFrame(asked, "id int, t0 long, t1 long"), 5), "id", "t") == sorted(want)
    assert cube.snap(data.where("false"), spark.createDataFrame(asked, "id int, t0 long, t1 long")).count() == 0


def test_ceil_hour(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 01:00:00' a, timestamp_ntz'2024-01-01 01:00:00.000001' b")
    got = df.select(temporal.ceil_hour(F.col("a")).alias("a"), temporal.ceil_hour(F.col("b")).alias("b")).first()
    assert got["b"] - got["a"] == 3600


def test_trim_and_interpolate(spark):
    df = spark.createDataFrame([(1, d, v) for d, v in enumerate([None, 1.0, None, None, 4.0, None])], "k int, date int, v double")
    out = temporal.interpolate(temporal.trim(df, "v", ("k",)), "v", F.col("date"), ("k",))
    assert rows(out, "date", "v") == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_deaccumulate_inverts_cumsum(spark):
    df = spark.createDataFrame([(1, f, float(v)) for f, v in enumerate([1, 3, 6])], "run int, f int, v double")
    assert [r["step"] for r in temporal.deaccumulate(df).orderBy("f").collect()] == [1.0, 2.0, 3.0]


def test_intervals_tile(spark):
    spans = spark.createDataFrame([(1, 0, 25), (2, 5, 5)], "id int, t0 long, t1 long")
    assert rows(temporal.intervals(spans, 10), "t_start", "t_end") == [(0, 10), (10, 20), (20, 25)]
    assert rows(temporal.intervals(spans, 10, cut=False), "t_end")[-1] == (30,)


def test_reply(spark):
    got = spark.createDataFrame([("1.5,2\n10,20",)], "r string").select(F.explode(temporal.parse_reply(F.col("r"))).alias("x")).select("x.*")
    assert rows(got, "t", "v") == [("10", 1.5), ("20", 2.0)]


# graphs


def test_cycle_and_long_chain(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.reach(links, start), "id") == [("a",), ("b",), ("c",)]
    assert rows(graph.upstream(links, start), "id") == [("a",), ("b",), ("c",), ("x",)]
    assert rows(graph.reach(links, start, "all", 1), "id") == [("a",), ("b",), ("c",), ("x",)]


# stations


def test_ties_and_tiers(spark):
    near = spark.createDataFrame([(1, s, d) for s, d in enumerate([3.0, 5.0, 5.0, 9.0])] + [(2, 9, 150.0), (2, 10, 900.0)], "id int, station int, dist double")
    assert rows(stations.nearest(near, 2), "id", "station") == [(1, 0), (1, 1), (1, 2), (2, 9), (2, 10)]
    assert rows(stations.first_tier(near).where("id = 2"), "station", "tier") == [(9, 2)]


@pytest.mark.parametrize("radius", [30.0, 900.0, 6000.0, 30000.0])
def test_radius_search_is_whole(spark, radius):
    rng = np.random.default_rng(5)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150))]
    spots += [(179.9, 10.0), (-179.9, 10.0), (180.0, 10.1), (0.0, 90.0), (100.0, 89.9), (-60.0, 89.8), (0.0, -90.0), (170.0, -89.9), (10.0, 0.0), (10.1, 0.1)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "station int, lon double, lat double")
    got = rows(stations.distances(table.withColumnRenamed("station", "id"), table, radius), "id", "station")

    def apart(p, q):
        (a, b), (c, d) = np.radians(p), np.radians(q)
        return float(np.arccos(np.clip(np.sin(b) * np.sin(d) + np.cos(b) * np.cos(d) * np.cos(c - a), -1, 1))) * scalar.EARTH_KM

    assert got == [(i, j) for i in range(len(spots)) for j in range(len(spots)) if apart(spots[i], spots[j]) <= radius]


def test_tiers_are_searched_one_after_another(spark):
    places = spark.createDataFrame([(1, 10.0, 50.0), (2, 20.0, 50.0), (3, 100.0, 0.0)], "id int, lon double, lat double")
    table = spark.createDataFrame([(1, 10.1, 50.0), (2, 10.0, 50.5), (3, 21.0, 50.0)], "station int, lon double, lat double")
    want = stations.first_tier(stations.distances(places, table, 1000.0))
    assert rows(stations.tiered(places, table), "id", "station", "tier") == rows(want, "id", "station", "tier") == [(1, 1, 1), (2, 3, 2)]


def test_equal_points_are_zero_apart(spark):
    d = spark.range(1).select(scalar.great_circle(F.lit(13.37), F.lit(51.2), F.lit(13.37), F.lit(51.2)).alias("d")).first()["d"]
    assert d == pytest.approx(0, abs=1e-4)


def test_idw_bounds_and_missing(spark):
    near = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "id int, station int, dist double")
    day = datetime(2024, 1, 1).date()
    series = spark.createDataFrame([(1, day, 4.0, 5.0, 1.0), (2, day, 8.0, 9.0, None)], "station int, date date, mean double, max double, min double")
    r = stations.inverse_distance(series, near).first()
    assert r["mean"] == pytest.approx(4.8) and (r["max"], r["min"]) == (7.0, 1.0)


def test_area_weighted_missing(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 4.0, 2.0), (2, None, 1.0), (2, 1.0, 1.0)], "id int, v double, area double")
    assert rows(stations.area_weighted(df, ("id",)), "id", "avg") == [(1, 3.0), (2, None)]


# systems of coordinates


def test_projection_corner(spark):
    x, y = crs.to_stereographic(F.lit(3.5889), F.lit(46.9526))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(-523.46, abs=0.01) and r["y"] == pytest.approx(-4658.64, abs=0.01)
    lon, lat = crs.from_web_mercator(*crs.to_web_mercator(F.lit(13.4), F.lit(51.0)))
    r = spark.range(1).select(lon.alias("x"), lat.alias("y")).first()
    assert (r["x"], r["y"]) == (pytest.approx(13.4), pytest.approx(51.0))


# services


def test_requests_and_parsers(spark, tmp_path):
    url = services.sensor_url("http://h/api", "N W", "d", "s", datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert "N%20W" in url and "start=2024-01-01" in url
    assert "start" not in services.sensor_url("http://h", "n", "d", "s", datetime(2024, 1, 1))
    assert len(services.chunks(datetime(2024, 1, 1), datetime(2024, 1, 20))) == 3
    with pytest.raises(ValueError):
        services.gauge_envelope("Q_9h", "1", datetime(2024, 1, 1), datetime(2024, 1, 2))
    wert = "<n:wert><n:zeitstempel>2024-07-01T02:00:00</n:zeitstempel><n:wert>1.5</n:wert><n:status>ok</n:status></n:wert>"
    reply = f"<e><n:spur>{wert}{wert}</n:spur></e>"
    got = services.parse_gauge(spark.createDataFrame([("g", reply)], "station string, reply string")).collect()
    assert [(r["ts"], r["v"], r["status"]) for r in got] == [(datetime(2024, 7, 1), 1.5, "ok")]
    geo = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[0,2]]]}}'
    rings = spark.createDataFrame([(geo,)], "g string").select(services.parse_geojson(F.col("g")).alias("r"))
    back = rings.select(services.to_geojson(F.col("r"), F.struct(F.lit(1).alias("id"))).alias("g")).first()["g"]
    assert '"coordinates":[[[0.0,0.0],[2.0,0.0],[0.0,2.0]]]' in back
    (tmp_path / "t.csv").write_text("id;v\na;1,5\n")
    assert rows(services.read_comma_decimal(spark, str(tmp_path / "t.csv"), ["v"]), "id", "v") == [("a", 1.5)]
    hits = '{"hits":{"hits":[{"_source":{"sensorCode":"s","networkCode":"n","deviceCode":"d","phenomenon":"p","uom":"u","geometry":{"coordinates":[13.0,51.0]}}}]}}'
    found = services.parse_stations(spark.createDataFrame([(hits,)], "reply string"))
    assert rows(services.filter_stations(found, ["n"], ["p"], (12, 14, 50, 52)), "sensorCode", "lon") == [("s", 13.0)]
    assert "PropertyIsEqualTo" in services.feature_request("a", {"k": "v<"}) and "v&lt;" in services.feature_request("a", {"k": "v<"})
    assert "geo_bounding_box" in services.station_query(["n"], None, (0, 1, 2, 3))


def fetched(url, request):
    return f"{url} {'Q_1h' in request}"


def test_gauge_source(spark):
    spark.dataSource.register(services.GaugeSource)
    assert services.GaugeSource.name() == "gauge"
    options = {"stations": "a,b", "start": "2024-01-01", "end": "2024-01-20", "parameter": "Q_1h", "url": "u", "fetch": "test_operators.fetched"}
    reader = services.GaugeReader(options)
    assert len(reader.partitions()) == 6
    assert list(reader.read(reader.partitions()[0])) == [("a", "u True")]


# sinks


def test_sinks(spark, tmp_path):
    png = sinks.palette_png(np.array([[0, 1], [1, 0]]), [(255, 0, 0)])
    assert png[:4] == b"\x89PNG" and len(png) > 60
    grid = sinks.class_map(spark.createDataFrame([(0, 0, 2), (1, 1, None)], "ix int, iy int, class int"), 2, 2)
    assert grid.tolist() == [[0, 0], [2, 0]]
    df = spark.createDataFrame([(1, 2.0, None), (2, None, "bad")], "catchment int, v double, error string")
    sinks.write_keyed_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).where("error = 'bad'").count() == 1
    steps = sinks.write_steps(spark.createDataFrame([(1, 0, 0, 2.0)], "t long, ix int, iy int, v double"), lambda t, x: x["grid"].tobytes(), 1, 1)
    assert np.frombuffer(steps.first()["content"]).tolist() == [2.0]


# ingestion


def test_late_steps_and_replays(spark, small, tmp_path):
    target = str(tmp_path / "t")
    assert ingest.update(target, small.where("t = 3")) == 1
    assert ingest.update(target, small, append_only=True) == 0
    assert ingest.update(target, small) == 5
    assert ingest.update(target, small) == 0


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([(i, datetime(2024, 1, 1, i % 3, 5), float(i)) for i in range(9)], "station int, ts timestamp, v double").write.parquet(src)
    stream = ingest.hourly_stream(ingest.deduplicated_stream(spark.readStream.schema("station int, ts timestamp, v double").parquet(src)), None)
    q = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and set(spark.table("hours").columns) == {"station", "hour", "v", "n"}


# the water balance


def site(name="Grass Land", layers=4, **k):
    full = lambda v: np.full(layers, v)
    soil = model.Soil(full(100.0), full(0.1), full(-7.9), full(0.266), full(0.435), full(5.0), full(5.5), full(0.92))
    return model.Column(LAND_COVER[name], soil, np.radians(51), **k)


def two_years():
    d = np.arange(731)
    doy = np.where(d < 366, d + 1, d - 365)
    rng = np.random.default_rng(3)
    tmax = 14 - 11 * np.cos(2 * np.pi * doy / 365) + rng.normal(0, 2, 731)
    tmin = tmax - 8
    return {
        "doy": doy, "month": np.minimum(12, (doy - 1) // 30.6 + 1).astype(int), "solrad": 10 - 8 * np.cos(2 * np.pi * doy / 365), "tmax": tmax, "tmin": tmin,
        "ea": 0.85 * model.esat(tmin)[0], "uw": np.full(731, 3.0), "prec": np.where(rng.random(731) < 0.4, rng.exponential(5, 731), 0.0), "mesfl": np.zeros(731),
    }


def test_water_is_conserved_and_bounded():
    cols = [site(n) for n in LAND_COVER] + [site("Grass Land", 1), site("Grass Land", idepth=300.0, infexp=1.0), site("Cultivated", gsc=0.1, gsp=0.1)]
    out = model.simulate(cols, two_years())
    assert all(np.isfinite(v).all() for v in out.values())
    assert np.abs(out["balerd"]).max() < 0.003
    assert (out["swatt"] > 0).all() and (out["snoww"] >= 0).all() and (out["trandd"] >= 0).all() and (out["floww"] >= -1e-9).all()
    assert out["snoww"].max() > 0 and out["smltd"].max() > 0
    assert (out["awatt"] == 0).all()
    top = np.array([model.State([c]).swatmx.sum() for c in cols])
    assert (out["swatt"] <= top[:, None] * (1 + 1e-5)).all()


def test_side_by_side_equals_alone():
    w = {k: v[:60] for k, v in two_years().items()}
    both = model.simulate([site("Grass Land"), site("Cultivated", 6)], w)
    alone = model.simulate([site("Cultivated", 6)], w)
    assert np.allclose(both["swatt"][1], alone["swatt"][0], rtol=1e-6)


def test_columns_equal_arrays(spark):
    t = np.linspace(-20, 35, 56)
    df = spark.createDataFrame([(float(x),) for x in t], "t double")
    es, delta = hydro.esat(F.col("t"))
    got = np.array([[r["a"], r["b"]] for r in df.select(es.alias("a"), delta.alias("b")).collect()])
    assert np.allclose(got.T, np.array(model.esat(t)))
    daylen, i0h = hydro.flat_sun(F.lit(0.89), F.col("t") * 5 + 110)
    slf = hydro.slope_factor(F.lit(0.89), F.col("t") * 5 + 110, F.lit(0.1), F.lit(3.0))
    got = np.array([[r[0], r[1], r[2]] for r in df.select(daylen, i0h, slf).collect()])
    n = np.ones(56)
    assert np.allclose(got.T, np.array(model.sun(0.89 * n, 0.1 * n, 3.0 * n, t * 5 + 110)), rtol=1e-6)


def test_failed_runs_are_reported(spark, sf):
    from fluvigrid.plans.catalogue import _runs

    runs, weather = _runs(spark, sf)
    bad = runs.where("catchment = 0").withColumn("cover", F.when(F.col("soil") == "0", F.lit("Moon")).otherwise(F.col("cover")))
    out = brook90.run(bad, weather)
    assert out.where("error like '%Moon%'").count() >= 1 and out.where("error is null").count() > 0
    avg = brook90.catchment_average(out)
    assert {r["status"] for r in avg.select("status").distinct().collect()} <= {"warn", "error"}
    assert brook90.wide(avg, [0]).columns == ["date", "0_swatt_avg"]
    with pytest.raises(ValueError):
        brook90.run(bad, weather, "sideways")


def test_totals_and_overrides(spark, sf):
    from fluvigrid.plans.catalogue import _runs

    runs, weather = _runs(spark, sf)
    own = runs.where("catchment = 1")
    daily = brook90.run(own, weather).cache()
    days = daily.toPandas()
    got = brook90.totals(daily).toPandas()
    one = days[(days.cover == days.cover[0]) & (days.soil == days.soil[0])].sort_values("date")
    whole = got[got.year.isna() & (got.cover == days.cover[0]) & (got.soil == days.soil[0])]
    assert len(whole) == 1 and whole.days.iloc[0] == len(one)
    assert whole.evpp.iloc[0] == pytest.approx(one.evpp.sum()) and whole.swatt.iloc[0] == one.swatt.iloc[-1]
    months = got[got.month.notna()]
    assert months.floww.sum() == pytest.approx(days.floww.sum()) and months.days.sum() == len(days)
    with pytest.warns(UserWarning, match="nonsense"):
        bare = brook90.run(own, weather, overrides={"maxlai": 0.0, "nonsense": 1.0})
    assert bare.agg(F.sum("trandd")).first()[0] < 0.1 * days.trandd.sum()


def test_flood_features(spark):
    q = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 30), 2.0)], "station int, ts timestamp, v double")
    rain = spark.createDataFrame([(0, 1.0)], "t long, v double")
    fc = spark.createDataFrame([(600, 0, 9.0), (600, 1, 3.0)], "run long, f int, v double")
    got = {r["kind"]: r for r in app.flood_features(q, rain, fc).collect()}
    assert got["p"]["vals"] == "1.0,3.0" and got["p"]["times"] == "600,4200" and got["q"]["vals"] == "2.0"


def test_forecast_files(spark, tmp_path):
    import bz2
    from dataclasses import replace

    from fluvigrid.sources import forecast

    p = replace(catalog.FORECAST["tot_prec"], grid=Grid(0, 2, 0, 1, 2, 1))
    run = datetime(2024, 1, 1, 3)
    for step, cells in ((0, [1.0, np.nan]), (1, [3.0, 4.0])):
        file = tmp_path / forecast.file_path("", "tot_prec", run, step).lstrip("/")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(bz2.compress(np.array(cells).tobytes()))
    got = forecast.read_forecast(spark, str(tmp_path), p, lambda raw: np.frombuffer(raw).reshape(1, 2))
    assert rows(got, "f", "ix", "v") == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    with pytest.raises(FileNotFoundError):
        forecast.read_forecast(spark, str(tmp_path), p, lambda raw: None, [1, 2])
    with pytest.raises(ValueError):
        forecast.check_steps(datetime(2024, 1, 1, 6), [28])
    assert forecast.check_steps(run, [45, 3, 3]) == [3, 45]


def test_steep_slopes_meet_the_sun_twice(spark):
    from fluvigrid.plans import model

    lat, slope = 1.05, 1.2
    doy, aspects = np.arange(100.0, 260.0, 20), [0.0, 0.4, 3.0]
    rows = [(float(d), a) for d in doy for a in aspects]
    got = spark.createDataFrame(rows, "doy double, aspect double").select(hydro.slope_factor(F.lit(lat), F.col("doy"), F.lit(slope), F.col("aspect")).alias("f")).collect()
    d, a = np.array(rows).T
    want = model.sun(np.full(len(d), lat), np.full(len(d), slope), a, d)[2]
    assert np.allclose([r["f"] for r in got], want, atol=1e-9) and max(want) > 0


def test_parts_of_steps(spark, tmp_path):
    rows = [(t, x, 0, float(t + x)) for t in (1, 3600, 40_000_000) for x in range(4)]
    whole = spark.createDataFrame(rows, "t long, ix int, iy int, v double")
    target = str(tmp_path / "target")
    assert ingest.update(target, whole.where("ix < 3")) == 9
    assert ingest.update(target, whole.where("ix > 0")) == 3
    assert ingest.update(target, whole) == 0 and ingest.update(target, whole.where("false")) == 0
    path = str(tmp_path / "cube")
    cube.append_steps(whole.where("t = 1"), path)
    cube.append_steps(whole, path)
    cube.append_steps(whole, path)
    assert sorted(map(tuple, cube.read_cube(spark, path).select("t", "ix", "iy", "v").collect())) == rows
    cube.replace_steps(whole.where("t = 3600 and ix < 2").withColumn("v", F.lit(9.0)), path, str(tmp_path / "staging"))
    want = [r for r in rows if r[0] != 3600] + [(3600, 0, 0, 9.0), (3600, 1, 0, 9.0)]
    assert sorted(map(tuple, cube.read_cube(spark, path).select("t", "ix", "iy", "v").collect())) == sorted(want)


def test_reach_by_doubling_equals_the_frontier(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, i))) for i in range(1, 60)] + [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(110, 101), (200, 200)]
    links = spark.createDataFrame(rows + rows[:3], "src long, dst long")
    starts = spark.createDataFrame([(i,) for i in (0, 3, 59, 102, 110, 200, 999)], "id long")
    apart = links.union(spark.createDataFrame([(500, 501), (500, 502)], "src long, dst long"))  # no longer one way
    for mode in ("in", "out"):
        for order in (None, 1, 2, 5):
            got, want = (sorted(map(tuple, graph.reach(g, starts, mode, order).collect())) for g in (links, apart))
            assert got == want and len(got) > 6


# application layer


def square(x, y, side=1.0):
    return [[Row(x=x, y=y), Row(x=x + side, y=y), Row(x=x + side, y=y + side), Row(x=x, y=y + side)]]


def test_merged_outline_has_holes_and_parts(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]  # a square around a hole, and one apart
    cells = [(i, square(float(x), float(y))) for i, (x, y) in enumerate([*ring, (7, 7)])]
    cells[2] = (2, [list(reversed(cells[2][1][0]))])  # a clockwise one
    polys = spark.createDataFrame([*cells, cells[0], (99, square(50.0, 50.0))], f"id int, rings {zonal.RINGS}")
    groups = spark.createDataFrame([(i, 5) for i in range(len(cells))], "id int, group int")
    merged = zonal.merged_outline(polys, groups)
    got = merged.select("id", F.transform("rings", zonal.signed_area).alias("areas")).collect()
    assert [(r.id, r.areas) for r in got] == [(5, [9.0, 1.0, -1.0])] or [(r.id, r.areas) for r in got] == [(5, [9.0, -1.0, 1.0])]
    assert merged.select(zonal.inside(F.col("rings"), F.lit(1.5), F.lit(1.5)).alias("i")).first()["i"] is False
    assert zonal.merged_outline(polys.where("false"), groups).count() == 0


def test_merged_outline_of_corners(spark):
    polys = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(1.0, 1.0))], f"id int, rings {zonal.RINGS}")  # they touch in a point
    merged = zonal.merged_outline(polys, spark.createDataFrame([(1, 0), (2, 0)], "id int, group int")).first()
    assert sorted(len(r) for r in merged.rings) == [4, 4]


def test_upstream_catchments(spark):
    shapes = [(i, float(i), square(float(i), 0.0)) for i in range(4)]
    catchments = spark.createDataFrame(shapes, f"id int, area_sqkm double, rings {zonal.RINGS}")
    links = spark.createDataFrame([(3, 2), (2, 1), (0, 1)], "src int, dst int")
    starts = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(app.catchments_upstream(catchments, links, starts), "start", "id") == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]
    merged = app.catchments_upstream(catchments, links, starts, merge=True)
    areas = merged.select("id", "n", "area_sqkm", zonal.signed_area(F.col("rings")[0]).alias("shape"), F.size("rings").alias("k"))
    assert rows(areas, "id", "n", "area_sqkm", "shape", "k") == [(1, 4, 6.0, 4.0, 1), (2, 2, 5.0, 2.0, 1)]


def test_request_without_catchment_is_an_error(spark):
    polys = spark.createDataFrame([(7, square(0.0, 0.0))], f"id int, rings {zonal.RINGS}")
    known = spark.createDataFrame([("s", 9), ("s", 8)], "station string, id int")
    asked = spark.createDataFrame([(1, "s", 0.5, 0.5), (2, None, 0.5, 0.5), (3, "t", 0.5, 0.5), (4, None, 5.0, 5.0)], "pid int, station string, x double, y double")
    found = app.catchment_ids(asked, polys, known, strict=False)
    assert {r.pid: r.id for r in found.collect()} == {1: 8, 2: 7, 3: None, 4: None}
    assert rows(app.catchment_ids(asked.where("pid < 3"), polys, known), "pid", "id") == [(1, 8), (2, 7)]
    with pytest.raises(Exception, match="no catchment for request"):
        app.catchment_ids(asked, polys, known).collect()


def test_requests_to_cubes(spark, small, tmp_path):
    box = cube.request(small, box=(0, 1, 0, 0), t=(1, 2))
    assert rows(box, "t", "sum") == [(1, 4.0)]
    assert rows(cube.request(small, t=(2, 9), stats=False), "t", "v") == sorted([(2, None), (2, None), (3, 5.0)], key=str)
    cells = zonal.overlap_boxes(spark.createDataFrame([(1, 0.0, 2.0, 0.0, 1.0)], "id int, xmin double, xmax double, ymin double, ymax double"))
    assert rows(cube.request(small, overlap=cells), "id", "t", "sum") == [(1, 1, 4.0)]
    assert cube.dropped(cube.statistics(small)).first() == (3, 1)
    with pytest.raises(ValueError):
        cube.request(small, box=(0, 0, 0, 0), overlap=cells)
    path = str(tmp_path / "c")
    cube.write_cube(small.withColumn("t", F.col("t") * 30_000_000), path)
    start, end = datetime(1970, 1, 2), datetime(1973, 1, 1)
    assert rows(app.radar_series(spark, path, start, end), "t", "max") == [(30_000_000, 3.0), (90_000_000, 5.0)]
    with pytest.raises(LookupError):
        app.radar_series(spark, path, datetime(1990, 1, 1), datetime(1991, 1, 1))
    with pytest.raises(ValueError):
        app.radar_series(spark, path, end, start)


def test_created_cube_is_empty_until_written(spark, tmp_path):
    path = str(tmp_path / "tot_prec")
    product = catalog.FORECAST["tot_prec"]
    cube.create_cube(spark, path, product, forecast=True)
    assert cube.open_cube(spark, path).count() == 0 and cube.attribute(spark, path, "f") == "hours 0 45"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        cube.create_cube(spark, path, product, forecast=True)
    run = 1_700_000_000 // 86_400 * 86_400
    totals = spark.createDataFrame([(run, f, 0, 0, 2.0 * f) for f in range(28)] + [(run + 3600, 0, 0, 0, 1.0)], "run long, f int, ix int, iy int, v double")
    now = datetime(2023, 12, 31)
    app.update_forecast_year(str(tmp_path), product, totals.where("f < 20"), now)  # not complete yet
    assert cube.open_cube(spark, path).count() == 0
    for _ in range(2):
        app.update_forecast_year(str(tmp_path), product, totals, now)
    assert rows(cube.open_cube(spark, path), "run", "f", "v", "year") == [(run, f, 2.0 if f else 0.0, 2023) for f in range(28)]


def test_replies_with_features(spark, tmp_path):
    text = '<w:C><g:member><a:r g:id="1"><a:n>x &lt; y</a:n><a:s><g:posList>1 2 3 4 5 6</g:posList><g:posList> 7\n8 </g:posList></a:s></a:r></g:member><g:member><a:r><a:k>1</a:k></a:r></g:member></w:C>'
    replies = spark.createDataFrame([(1, text), (2, "<ows:ExceptionReport/>"), (3, None), (4, "")], "id int, reply string")
    got = services.parse_features(replies, "a:r", ["n", "k"]).collect()
    assert [(r.id, r.n, r.k, [[tuple(p) for p in ring] for ring in r.rings]) for r in got] == [(1, "x < y", None, [[(1, 2), (3, 4), (5, 6)], [(7, 8)]]), (1, None, "1", [])]
    one, two = "[[[0,0],[1,0],[1,1]]]", "[[[5,5],[6,5],[6,6]],[[5.1,5.1],[5.2,5.1],[5.2,5.2]]]"
    shapes = [f'{{"type":"Polygon","coordinates":{one}}}', f'{{"type":"MultiPolygon","coordinates":[{one},{two}]}}', '{"type":"Point","coordinates":[1,2]}', "no json", None]
    parts = spark.createDataFrame([(s,) for s in shapes], "s string").select(services.parse_parts(F.col("s")).alias("p"), services.parse_geojson(F.col("s")).alias("r")).collect()
    assert [None if r.p is None else [len(p) for p in r.p] for r in parts] == [[1], [1, 2], None, None, None]
    assert [None if r.r is None else len(r.r) for r in parts] == [1, 3, None, None, None]
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[' + ",\n".join(f'{{"type":"Feature","properties":{{"id":{i},"name":"n"}},"geometry":{s}}}' for i, s in enumerate(shapes[:2])) + "]}")
    assert rows(services.read_geojson(spark, str(tmp_path / "f.json"), ["id", "name"]), "id", "name", "part") == [("0", "n", 0), ("1", "n", 0), ("1", "n", 1)]


def test_discharge_asks_the_chosen_service(spark):
    known = spark.createDataFrame([("s",)], "station string")
    asked = {"gauge": lambda *a: a, "sensor": lambda *a: a[0]}
    assert app.discharge(known, "s", 1, 2, asked, "gauge") == ("s", 1, 2) and app.discharge(known, "s", 1, 2, asked, "sensor") == "s"
    with pytest.raises(LookupError):
        app.discharge(known, "x", 1, 2, asked, "gauge")
    with pytest.raises(ValueError):
        app.discharge(known, "s", 1, 2, asked, "other")
