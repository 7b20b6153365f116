"""Radar composites: file names, binary decoding, and a scan of folders into a long table.

A file is an ASCII header up to the first ETX byte, then ny x nx little-endian cells from the bottom row up.
Decoding keeps this order: source bit, no-data, precision, reflectivity.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Product

ETX = b"\x03"
SOURCE_BIT = 4096
_SCHEMA = "product string, t timestamp, prediction int, ix int, iy int, v double"


def name_regex(product: Product) -> str:
    """A pattern with the file's time as group 1 and its prediction, if any, as group 2."""
    quoted = re.escape(product.file_pattern)
    return quoted.replace(re.escape("%%time%%"), r"(\d{10})").replace(re.escape("%%prediction%%"), r"(\d{3})")


def name_value(file: Column, product: Product, what: str = "time") -> Column:
    """The timestamp or the prediction that a file name holds; null where the name does not fit."""
    time, prediction = F.regexp_extract(file, name_regex(product), 1), F.lit(None)
    if "%%prediction%%" in product.file_pattern:
        prediction = F.regexp_extract(file, name_regex(product), 2)
    if what == "time":
        return F.try_to_timestamp(F.nullif(time, F.lit("")), F.lit("yyMMddHHmm"))
    return F.nullif(prediction, F.lit("")).cast("int")


def decode_column(raw: Column, product: Product) -> Column:
    """The decoding rules on integer cells, as an expression."""
    v = raw
    if product.bytes == 2:
        v = F.when((v >= SOURCE_BIT) & (v < 2 * SOURCE_BIT), v - SOURCE_BIT).otherwise(v)
    v = F.when(v <= product.max_value, v.cast("double") * F.lit(product.precision))
    return F.greatest(F.lit(0.0), v / 2 - 32.5) if product.dbz else v


def decode(content: bytes, product: Product) -> np.ndarray:
    """The grid of one file, row 0 at the bottom; NaN where there are no data."""
    head = content.index(ETX)
    g = product.grid
    cells = np.frombuffer(content, "<u1" if product.bytes == 1 else "<u2", count=g.nx * g.ny, offset=head + 1).astype(np.int64)
    if product.bytes == 2:
        cells = np.where((cells >= SOURCE_BIT) & (cells < 2 * SOURCE_BIT), cells - SOURCE_BIT, cells)
    values = np.where(cells <= product.max_value, cells * product.precision, np.nan)
    if product.dbz:
        values = np.maximum(values / 2 - 32.5, 0.0)
    return values.reshape(g.ny, g.nx)


def unpack(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The files in an archive (.tar.gz, .tar.bz2, .tar, .gz, .bz2), or the file itself."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for member in archive:
                if member.isfile():
                    yield from unpack(member.name, archive.extractfile(member).read())
            return
    except tarfile.ReadError:
        pass
    if content[:2] == b"\x1f\x8b":
        yield name.removesuffix(".gz"), gzip.decompress(content)
    elif content[:3] == b"BZh":
        yield name.removesuffix(".bz2"), bz2.decompress(content)
    else:
        yield name, content


def read_radar(spark: SparkSession, path: str, product: Product, keep_missing: bool = False) -> DataFrame:
    """``product, t, prediction, ix, iy, v`` of all files below ``path`` whose names fit the product.

    Files are dealt to tasks by Spark's binary source; archives are opened in the task. Cells count from the lower
    left corner. Cells without data are left out unless ``keep_missing``.
    """
    pattern, fmt = re.compile(name_regex(product)), product.time_format

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = product.grid
        ix, iy = np.tile(np.arange(g.nx, dtype=np.int32), g.ny), np.repeat(np.arange(g.ny, dtype=np.int32), g.nx)
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for name, raw in unpack(file.rsplit("/", 1)[-1], content):
                    if not (fit := pattern.search(name)):
                        continue
                    v = decode(raw, product).ravel()
                    keep = slice(None) if keep_missing else ~np.isnan(v)
                    prediction = int(fit[2]) if fit.re.groups > 1 else None
                    out = pd.DataFrame({"product": product.name, "t": datetime.strptime(fit[1], fmt), "prediction": pd.array([prediction] * len(ix), "Int32"), "ix": ix, "iy": iy, "v": v})
                    yield out[keep]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    # names are judged before any content is read; an archive's members are judged in the task
    files = files.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(f"{pattern.pattern}|[.](tar|tgz|tar[.]gz|tar[.]bz2)$"))
    return files.mapInPandas(rows, _SCHEMA).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def at_or_before(available: DataFrame, target: Column, interval: int, most_back: int = 5) -> DataFrame:
    """The newest step at most ``most_back`` intervals before ``target`` among ``available`` (t in seconds)."""
    return available.where((F.col("t") <= target) & (F.col("t") >= target - most_back * interval)).agg(F.max("t").alias("t"))
