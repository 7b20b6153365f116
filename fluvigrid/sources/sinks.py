"""Sinks: keyed CSV with an error channel, palette images, GeoTIFF-like dumps through a pluggable encoder, table upkeep."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_keyed_csv(results: DataFrame, path: str, key: str = "catchment") -> None:
    """One folder per key; rows carry ``error``, so a failed key is reported where its result would be."""
    results.repartition(key).write.partitionBy(key).mode("overwrite").option("header", "true").csv(path)


def palette_png(classes: np.ndarray, colors: list[tuple[int, int, int]]) -> bytes:
    """A paletted PNG of a class grid (0 is transparent), rows from the top."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + row.astype(np.uint8).tobytes() for row in classes)
    palette = b"".join(bytes(c) for c in [(0, 0, 0), *colors])
    head = struct.pack(">IIBBBBB", classes.shape[1], classes.shape[0], 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"PLTE", palette) + chunk(b"tRNS", b"\x00") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def class_map(classified: DataFrame, nx: int, ny: int) -> np.ndarray:
    """The class grid of one step, rows from the top: an image's worth of cells, of known size nx x ny."""
    out = np.zeros((ny, nx), np.uint8)
    for r in classified.where(F.col("class").isNotNull() & F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1)).select("ix", "iy", "class").toLocalIterator():
        out[ny - 1 - r["iy"], r["ix"]] = r["class"]
    return out


def write_steps(cube: DataFrame, encode: Callable[[int, dict], bytes], nx: int, ny: int) -> DataFrame:
    """``t, content`` with each step as a file's content: steps are gathered in tasks, one grid at a time."""

    def one(key: tuple, frame):
        import pandas as pd

        grid = np.full((ny, nx), np.nan)
        grid[ny - 1 - frame["iy"].to_numpy(), frame["ix"].to_numpy()] = frame["v"].to_numpy()
        return pd.DataFrame({"t": [key[0]], "content": [encode(key[0], {"grid": grid})]})

    return cube.groupBy("t").applyInPandas(one, "t long, content binary")


def replace_table(df: DataFrame, name: str, partition: str | None = None) -> None:
    """Create a managed table anew."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.format("parquet")
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
