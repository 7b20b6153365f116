"""Shared helpers: the shared work folder, table reading and hash primitives."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only on a single machine, where that setting may be absent (tests), is a folder of our own made, which goes when
    the process ends; on a cluster an absent setting is an error, as executors don't see each other's disks.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="fluvigrid-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
            spark.sparkContext.setCheckpointDir(_OWN[0])
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch that a Python worker is sent; a batch holds a row more than that at most.
BATCH_BYTES = 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``BATCH_BYTES``, so long texts don't add up in a worker.

    It stays lowered, as plans that an operator returns are run later; results don't depend on it.
    """
    if int(spark.conf.get(_BYTES, str(BATCH_BYTES)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int = BATCH_BYTES):
    """Actions inside send Python at most ``rows`` rows, or a row over ``size`` bytes, at once."""
    before = spark.conf.get(_ROWS), spark.conf.get(_BYTES)
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before[0])
        spark.conf.set(_BYTES, before[1])


def tidy(run):
    """``run`` over Arrow batches; at a task's end the worker, which lives on, hands unused memory back."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, vectorised; a bijection."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Bits of the membership filter: 256 pages of 4 KB, 1 MB in all, whatever the number of keys.
FILTER_BITS = 1 << 23


def membership(keys: DataFrame, name: str):
    """A function that adds ``_member`` to a table: never wrong about a member of ``keys[name]``, rarely about others.

    It thins out a large side before it is shuffled. The bitmap's size is fixed, so it is broadcast safely: with far
    more keys than bits it only lets more through. Expressions only.
    """
    place = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    bits = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("_page")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("_bits"))

    def marked(df: DataFrame, column: str) -> DataFrame:
        at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
        paged = df.withColumn("_page", F.floor(at / 32768).cast("int")).join(F.broadcast(bits), "_page", "left")
        byte = F.conv(F.hex(F.col("_bits").substr((F.floor(at % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
        return paged.withColumn("_member", F.coalesce(hit, F.lit(False))).drop("_page", "_bits")

    return marked
