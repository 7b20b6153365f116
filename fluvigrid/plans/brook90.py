"""Running the water-balance model over catchments: parameters, forcing, grouped simulation, area-weighted results."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import daily_energy, vapor_pressure, with_default
from ..operators import stations, temporal
from .model import OUTPUTS, Column, Soil, simulate
from .parameters import LandCover, flow, land_cover

SOIL_FIELDS = ("thick", "stonef", "psif", "thetaf", "thsat", "bexp", "kf", "wetinf")
WEATHER_FIELDS = ("doy", "month", "solrad", "tmax", "tmin", "ea", "uw", "prec", "mesfl")
#: Outputs that add up over days, and those that are a state at the end of a day.
FLOWS = ("precc", "evpp", "floww", "irvpp", "isvpp", "ptrann", "pintt", "snvpp", "slvpp", "trandd", "smltd", "slfld", "rfald", "sfald")
STORES = ("snoww", "swatt")
_RESULT = "catchment long, cover string, soil string, area double, date date, error string, " + ", ".join(f"{k} double" for k in OUTPUTS)


def daily_input(forcing: DataFrame, by: tuple[str, ...] = ("catchment",)) -> DataFrame:
    """Model input from daily means (date, tmin, tmax, radiation W/m2, rh 0..1, wind, precip): trimmed to the days with
    temperatures, temperatures interpolated, other gaps filled with defaults."""
    trimmed = temporal.trim(temporal.trim(forcing, "tmax", by), "tmin", by)
    for name in ("tmin", "tmax"):
        trimmed = temporal.interpolate(trimmed, name, F.unix_date("date"), by)
    mean = (F.col("tmin") + F.col("tmax")) / 2
    return trimmed.select(
        *by, "date", F.dayofyear("date").cast("double").alias("doy"), F.month("date").cast("double").alias("month"),
        with_default(daily_energy(F.col("radiation")), 0.0).alias("solrad"), "tmax", "tmin", with_default(vapor_pressure(mean, F.col("rh")), 0.0).alias("ea"),
        with_default(F.col("wind"), 0.1, zero_too=True).alias("uw"), with_default(F.col("precip"), 0.0).alias("prec"), F.lit(-1.0).alias("mesfl"),
    )


def join_forcing(series: dict[str, DataFrame], on: tuple[str, ...] = ("catchment", "date")) -> DataFrame:
    """Full outer join of daily series (keys.., value) into one row per day with a column for each."""
    out = None
    for name, df in series.items():
        one = df.withColumnRenamed("value", name)
        out = one if out is None else out.join(one, list(on), "full")
    return out


def soil_profile(layers: DataFrame) -> DataFrame:
    """``soil, profile`` from layer rows (soil, layer, thick in m, ...): arrays in layer order, thickness in mm."""
    rows = F.sort_array(F.collect_list(F.struct("layer", *[(F.col(k) * 1000 if k == "thick" else F.col(k)).cast("double").alias(k) for k in SOIL_FIELDS])))
    return layers.groupBy("soil").agg(rows.alias("rows")).select("soil", F.struct(*[F.col(f"rows.{k}").alias(k) for k in SOIL_FIELDS]).alias("profile"))


def parameters(characteristics: DataFrame, profiles: DataFrame, terrain: DataFrame) -> DataFrame:
    """One row per run: (catchment, cover, soil, area) with its profile, latitude (degrees) and slope (degrees)."""
    return characteristics.join(profiles, "soil").join(terrain, "catchment")


def _column(row: dict, flow_type: str, dtimax: float, cover: dict[str, float]) -> Column:
    p = row["profile"]
    idepth, infexp = flow(flow_type)
    return Column(
        replace(land_cover(row["cover"]), **cover), Soil(**{k: np.array(p[k], float) for k in SOIL_FIELDS}), np.radians(row["latitude"]), np.radians(row["slope"]), np.radians(row.get("aspect") or 0.0), idepth, infexp, dtimax
    )


def run(runs: DataFrame, weather: DataFrame, flow_type: str = "topdown", dtimax: float = 0.5, overrides: dict[str, float] | None = None) -> DataFrame:
    """Simulate every run under its catchment's weather: ``catchment, cover, soil, area, date, error`` and daily outputs.

    A catchment is one group: its runs are few and are simulated side by side, so a group is one catchment's days
    and parameter sets. A run that cannot be built or that fails gives one row with ``error`` and null outputs.
    ``overrides`` sets parameters of all land covers; names that there are none of are left out with a warning.
    """
    flow(flow_type)
    known = {f.name for f in fields(LandCover)}
    if unknown := sorted(set(overrides or {}) - known):
        warnings.warn(f"unknown parameters are not set: {', '.join(unknown)}", stacklevel=2)
    cover = {k: v for k, v in (overrides or {}).items() if k in known}
    days = weather.groupBy("catchment").agg(F.sort_array(F.collect_list(F.struct("date", *WEATHER_FIELDS))).alias("days"))
    packed = runs.groupBy("catchment").agg(F.collect_list(F.struct(*[c for c in runs.columns if c != "catchment"])).alias("runs")).join(days, "catchment")

    def failed(key: int, r: dict, why: str) -> pd.DataFrame:
        return pd.DataFrame([{"catchment": key, "cover": r["cover"], "soil": r["soil"], "area": r["area"], "date": None, "error": why} | dict.fromkeys(OUTPUTS, np.nan)])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, own, rows in zip(frame["catchment"], frame["runs"], frame["days"], strict=True):
                days = pd.DataFrame([dict(x) if isinstance(x, dict) else x.asDict() for x in rows])
                series = {k: days[k].to_numpy(float) for k in WEATHER_FIELDS}
                built, good = [], []
                for r in own:
                    r = dict(r) if isinstance(r, dict) else r.asDict(recursive=True)
                    try:
                        built.append(_column(r, flow_type, dtimax, cover))
                        good.append(r)
                    except (ValueError, KeyError, TypeError) as e:
                        yield failed(key, r, str(e))
                if not good:
                    continue
                with np.errstate(all="ignore"):
                    out = simulate(built, series)
                for i, r in enumerate(good):
                    if not np.isfinite(out["swatt"][i]).all():
                        yield failed(key, r, "the simulation did not stay finite")
                        continue
                    head = {"catchment": key, "cover": r["cover"], "soil": r["soil"], "area": r["area"], "date": days["date"], "error": None}
                    yield pd.DataFrame(head | {k: out[k][i] for k in OUTPUTS})

    return packed.mapInPandas(batches, _RESULT)


def catchment_average(results: DataFrame, value: str = "swatt", fail: float = 0.5) -> DataFrame:
    """``catchment, date, avg, status``: area-weighted over good runs; error where more than ``fail`` of the area failed."""
    areas = results.groupBy("catchment", "cover", "soil").agg(F.max("area").alias("area"), F.max(F.col("error").isNotNull()).alias("bad"))
    gate = stations.coverage_gate(areas.withColumnRenamed("catchment", "id"), ~F.col("bad"), 0.0, fail).withColumnRenamed("id", "catchment")
    mean = stations.area_weighted(results.where("error is null").withColumn("v", F.col(value)), ("catchment", "date"))
    return mean.join(gate.select("catchment", "status"), "catchment")


def totals(results: DataFrame, flows: tuple[str, ...] = FLOWS, stores: tuple[str, ...] = STORES) -> DataFrame:
    """Flows summed, and stores at their last day, over months, years and whole runs: ``catchment, cover, soil, year,
    month, days`` and the values; year or month are null in rows that span them. Failed runs have none."""
    good = results.where("error is null").withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    values = [F.sum(k).alias(k) for k in flows] + [F.max_by(k, "date").alias(k) for k in stores]
    sets = [("year", "month"), ("year",), ()]
    return good.groupingSets([["catchment", "cover", "soil", *s] for s in sets], "catchment", "cover", "soil", "year", "month").agg(F.count(F.lit(1)).alias("days"), *values)


def wide(averages: DataFrame, catchments: list[int], name: str = "swatt_avg") -> DataFrame:
    """One column per catchment, as ``<id>_<name>``, one row per date."""
    out = averages.groupBy("date").pivot("catchment", catchments).agg(F.first("avg"))
    return out.select("date", *[F.col(str(c)).alias(f"{c}_{name}") for c in catchments])


def long_window(end: Expr, years: int) -> tuple[Expr, Expr]:
    return temporal.model_window(end, years)
