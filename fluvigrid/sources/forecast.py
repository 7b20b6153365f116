"""Forecast files: paths, horizons, and a scan with a pluggable decoder (GRIB2 libraries are not part of the engine)."""

from __future__ import annotations

import bz2
import re
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FORECAST, Product, horizon

_NAME = re.compile(r"(\d{10})_(\d{3})")


def check_steps(run: datetime, steps: list[int]) -> list[int]:
    """The requested steps, sorted; those beyond the run's horizon are an error."""
    last = horizon(run.hour)
    if wrong := [s for s in steps if not 0 <= s <= last]:
        raise ValueError(f"the {run:%H} UTC run reaches from 0 to {last}, not {wrong}")
    return sorted(set(steps))


def file_path(root: str, parameter: str, run: datetime, step: int) -> str:
    """Files lie by hour of the run and parameter; the step has three digits."""
    product = FORECAST[parameter]
    return f"{root.rstrip('/')}/{run:%H}/{parameter}/{run.strftime(product.time_format)}_{step:03d}.grib2.bz2"


def read_forecast(spark: SparkSession, path: str, product: Product, decode: Callable[[bytes], np.ndarray], steps: list[int] | None = None) -> DataFrame:
    """``run, f, ix, iy, v`` of all files below ``path`` named by run and step; a missing last step is an error.

    ``decode`` turns a file's bytes into a grid with row 0 at the bottom; NaN marks cells without data.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = product.grid
        ix, iy = np.tile(np.arange(g.nx, dtype=np.int32), g.ny), np.repeat(np.arange(g.ny, dtype=np.int32), g.nx)
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                name = _NAME.search(file.rsplit("/", 1)[-1])
                if not name or (steps is not None and int(name[2]) not in steps):
                    continue
                v = decode(bz2.decompress(content) if content[:3] == b"BZh" else content).ravel()
                keep = ~np.isnan(v)
                run = np.int64(pd.Timestamp(datetime.strptime(name[1], product.time_format)).timestamp())
                yield pd.DataFrame({"run": run, "f": np.int32(name[2]), "ix": ix, "iy": iy, "v": v})[keep]

    # names are judged before any content is read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_[0-9][0-9][0-9]*").load(path)
    if steps is not None:
        files = files.where(F.regexp_extract("path", r"_(\d{3})[^/]*$", 1).isin(*[f"{s:03d}" for s in steps]))
    if steps is not None and not files.where(F.col("path").rlike(rf"\d{{10}}_{max(steps):03d}")).select("path").limit(1).count():
        raise FileNotFoundError(f"step {max(steps)} is not there")
    return files.select("path", "content").mapInPandas(rows, "run long, f int, ix int, iy int, v double")
