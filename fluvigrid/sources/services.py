"""Remote services: request builders, reply parsers, and a data source that splits time ranges into requests.

Fetching is a function that is passed in, so everything here works without a network.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from urllib.parse import quote, urlencode
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .catalog import GAUGE_PARAMETERS, GAUGE_REQUEST_DAYS, GAUGE_TIME_ZONE

ISO = "%Y-%m-%dT%H:%M:%SZ"
SENSOR_SCHEMA = "begin timestamp, v double"
STATION_SCHEMA = "sensorCode string, networkCode string, deviceCode string, phenomenon string, uom string, lon double, lat double, maxTime timestamp"


def http_get(url: str, timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # raises for replies that are no success
        return reply.read()


def sensor_url(base: str, network: str, device: str, sensor: str, start: datetime | None = None, end: datetime | None = None) -> str:
    """Request for a sensor's measurements; the time range goes along only if both ends are known."""
    url = f"{base.rstrip('/')}/networks/{quote(network)}/devices/{quote(device)}/sensors/{quote(sensor)}/measurements/raw"
    query = {"includeLatest": "true"}
    if start is not None and end is not None:
        query = {"start": start.strftime(ISO), "end": end.strftime(ISO)} | query
    return f"{url}?{urlencode(query)}"


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Stored sensor replies."""
    return spark.read.csv(path, schema=SENSOR_SCHEMA, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm[:ss]'Z'")


def station_query(networks: list[str] | None = None, phenomena: list[str] | None = None, box: tuple[float, float, float, float] | None = None, size: int = 10_000) -> str:
    """Search request for the sensor catalogue: lists of networks and phenomena, and a box (xmin, xmax, ymin, ymax)."""
    must: list[dict] = []
    if networks:
        must.append({"terms": {"networkCode": networks}})
    if phenomena:
        must.append({"terms": {"phenomenon": phenomena}})
    if box:
        must.append({"geo_bounding_box": {"geometry": {"top_left": {"lon": box[0], "lat": box[3]}, "bottom_right": {"lon": box[1], "lat": box[2]}}}})
    return json.dumps({"size": size, "query": {"bool": {"must": must}}})


def parse_stations(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Stations from search replies, one row per hit."""
    hit = "array<struct<_source:struct<sensorCode:string,networkCode:string,deviceCode:string,phenomenon:string,uom:string,geometry:struct<coordinates:array<double>>,sensor_stats:struct<max_time:timestamp>>>>"
    hits = replies.select(F.explode(F.from_json(column, f"hits struct<hits:{hit}>")["hits"]["hits"]).alias("h")).select("h._source.*")
    place = F.col("geometry.coordinates")
    return hits.select("sensorCode", "networkCode", "deviceCode", "phenomenon", "uom", place[0].alias("lon"), place[1].alias("lat"), F.col("sensor_stats.max_time").alias("maxTime"))


def filter_stations(stations: DataFrame, networks: list[str] | None = None, phenomena: list[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The same selection on a stored catalogue: predicates that reach the scan."""
    out = stations
    if networks:
        out = out.where(F.col("networkCode").isin(networks))
    if phenomena:
        out = out.where(F.col("phenomenon").isin(phenomena))
    return out.where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3])) if box else out


def chunks(start: datetime, end: datetime, days: int = GAUGE_REQUEST_DAYS) -> list[tuple[datetime, datetime]]:
    """A time range in requests of at most ``days``."""
    out, at = [], start
    while at < end:
        out.append((at, min(at + timedelta(days=days), end)))
        at = out[-1][1]
    return out


def gauge_envelope(parameter: str, station: str, start: datetime, end: datetime, user: str = "", password: str = "") -> str:
    """SOAP request for a gauge's series; times in the service's zone."""
    if parameter not in GAUGE_PARAMETERS:
        raise ValueError(f"unknown parameter {parameter!r}")
    tag = lambda name, value: f"<{name}>{escape(value)}</{name}>"
    body = tag("user", user) + tag("passwort", password) + tag("mstnr", station) + tag("spur", parameter) + tag("von", start.strftime("%Y-%m-%dT%H:%M:%S")) + tag("bis", end.strftime("%Y-%m-%dT%H:%M:%S"))
    return f'<soapenv:Envelope xmlns:soapenv="http://schemas.xmlsoap.org/soap/envelope/"><soapenv:Body><getSpur>{body}</getSpur></soapenv:Body></soapenv:Envelope>'


def parse_gauge(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``station, ts, v, status`` from replies (station, reply): values in spur/wert, each station and time once."""
    path = lambda name: F.xpath(F.regexp_replace(column, r"<(/?)\w+:", "<$1"), F.lit(f".//spur/wert/{name}/text()"))
    rows = replies.select("station", F.explode(F.arrays_zip(path("zeitstempel").alias("at"), path("wert").alias("v"), path("status").alias("status"))).alias("r"))
    out = rows.select("station", F.to_utc_timestamp(F.to_timestamp("r.at"), GAUGE_TIME_ZONE).alias("ts"), F.col("r.v").try_cast("double").alias("v"), F.col("r.status").alias("status"))
    return out.groupBy("station", "ts").agg(F.min(F.struct("v", "status")).alias("x")).select("station", "ts", "x.*")


def feature_request(typename: str, filters: dict[str, str], version: str = "1.1.0") -> str:
    """WFS GetFeature request: equalities, all of which must hold."""
    each = "".join(f"<ogc:PropertyIsEqualTo><ogc:PropertyName>{escape(k)}</ogc:PropertyName><ogc:Literal>{escape(v)}</ogc:Literal></ogc:PropertyIsEqualTo>" for k, v in filters.items())
    where = f"<ogc:Filter>{f'<ogc:And>{each}</ogc:And>' if len(filters) > 1 else each}</ogc:Filter>" if filters else ""
    return f'<wfs:GetFeature service="WFS" version="{version}" xmlns:wfs="http://www.opengis.net/wfs" xmlns:ogc="http://www.opengis.net/ogc"><wfs:Query typeName="{escape(typename)}">{where}</wfs:Query></wfs:GetFeature>'


def parse_features(replies: DataFrame, typename: str, properties: list[str], column: str = "reply") -> DataFrame:
    """Features of WFS replies, a row for each: the wanted properties as text (null where absent) and ``rings``.

    The columns besides ``reply`` stay. Rings come from position lists, x before y; a feature without one has none. A
    reply without features, an exception report too, gives no row.
    """
    tag = typename.rsplit(":", 1)[-1]
    plain = F.regexp_replace(column, r"<(/?)\w+:", "<$1")
    each = replies.withColumn("_f", F.explode(F.regexp_extract_all(plain, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))))
    numbers = lambda text: F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.cast("double"))
    pairs = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(v[i * 2].alias("x"), v[i * 2 + 1].alias("y")))
    rings = F.transform(F.regexp_extract_all("_f", F.lit(r"(?s)<posList[^>]*>\s*([^<]*?\S)\s*</posList>"), F.lit(1)), lambda text: pairs(numbers(text)))
    values = [F.get(F.xpath("_f", F.lit(f"//{name}/text()")), F.lit(0)).alias(name) for name in properties]
    return each.select(*[c for c in replies.columns if c != column], *values, rings.alias("rings"))


def _geometry(text: Column) -> tuple[Column, Column]:
    """Kind and coordinates, as JSON, of a GeoJSON feature or geometry."""
    feature = F.from_json(text, "type string, geometry struct<type:string,coordinates:string>, coordinates string")
    return F.coalesce(feature["geometry"]["type"], feature["type"]), F.coalesce(feature["geometry"]["coordinates"], feature["coordinates"])


def parse_parts(text: Column) -> Column:
    """Polygons (arrays of rings of x, y) of a GeoJSON polygon or multipolygon, feature or geometry; null for others."""
    kind, coordinates = _geometry(text)
    single = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    parts = F.when(kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>")).when(kind == "Polygon", single)
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def parse_geojson(text: Column) -> Column:
    """All rings (array of arrays of x, y) of a GeoJSON polygon or multipolygon, feature or geometry."""
    return F.flatten(parse_parts(text))


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Features of GeoJSON collections, one file or a folder of them: properties as text, ``part`` and ``rings``.

    A multipolygon has a row for each part. A file is parsed in one task: meant for collections of catchments or
    regions; larger tables belong into Parquet.
    """
    features = F.from_json("value", "features array<string>")["features"]
    each = spark.read.text(path, wholetext=True).select(F.explode(features).alias("f"))
    own = F.from_json("f", "properties map<string,string>")["properties"]
    return each.select(*[own[name].alias(name) for name in properties], F.posexplode(parse_parts(F.col("f"))).alias("part", "rings"))


def to_geojson(rings: Column, properties: Column) -> Column:
    """A GeoJSON feature of a polygon."""
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def read_comma_decimal(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Semicolon-separated tables with decimal commas."""
    df = spark.read.csv(path, sep=";", header=True)
    return df.select(*[F.regexp_replace(c, ",", ".").cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def two_digit_year(y: Column) -> Column:
    """Years of two digits: over 20 in the last century."""
    return F.when(y >= 100, y).when(y > 20, y + 1900).otherwise(y + 2000)


def remote_model(features: DataFrame, call: Callable[[dict], str], schema: str = "key string, reply string") -> DataFrame:
    """A remote model's replies for feature rows (key, ...): one call for each row, in the tasks."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            out = frame[["key"]].copy()
            out["reply"] = [call(row) for row in frame.to_dict("records")]
            yield out

    return features.mapInPandas(run, schema)


class _Chunk(InputPartition):
    def __init__(self, station: str, start: datetime, end: datetime):
        self.station, self.start, self.end = station, start, end


class GaugeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Chunk]:
        o = self.options
        start, end = (datetime.fromisoformat(o[k]) for k in ("start", "end"))
        return [_Chunk(s, a, b) for s in o["stations"].split(",") for a, b in chunks(start, end, int(o.get("days", GAUGE_REQUEST_DAYS)))]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        import importlib

        module, name = self.options["fetch"].rsplit(".", 1)
        request = gauge_envelope(self.options["parameter"], partition.station, partition.start, partition.end, self.options.get("user", ""), self.options.get("password", ""))
        yield partition.station, getattr(importlib.import_module(module), name)(self.options.get("url", ""), request)


class GaugeSource(DataSource):
    """``station, reply``: one partition for each station and request; ``fetch`` names a function (url, request) -> text."""

    @classmethod
    def name(cls) -> str:
        return "gauge"

    def schema(self) -> str:
        return "station string, reply string"

    def reader(self, schema) -> GaugeReader:
        return GaugeReader(dict(self.options))
