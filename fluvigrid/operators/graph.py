"""River networks: edges from columns, reachability, neighbourhoods, upstream areas."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that ``spark.checkpoint.dir`` names; a folder of our own, which goes with the
    process, only on a single machine where it is unset. On a cluster an unset folder is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="fluvigrid-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def edges(data: DataFrame, id_col: str, out_col: str | None = None, in_col: str | None = None, sep: str = ",", none: object | None = None, directed: bool = True) -> DataFrame:
    """``src, dst`` from columns that hold one or several neighbours, with a value that means none."""
    parts = []
    for col, outward in ((out_col, True), (in_col, False)):
        if col is None:
            continue
        cell = F.col(col).cast("string") if none is None else F.nullif(F.col(col).cast("string"), F.lit(str(none)))
        other = data.where(cell.isNotNull()).select(F.col(id_col).cast("string").alias("own"), F.explode(F.split(cell, sep)).alias("other")).select("own", F.trim("other").alias("other"))
        parts.append(other.select(F.col("own" if outward else "other").alias("src"), F.col("other" if outward else "own").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not directed:
        out = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out.distinct()


def reach(links: DataFrame, starts: DataFrame, mode: str = "out", order: int | None = None) -> DataFrame:
    """``start, id, hops``: everything within ``order`` hops (all, if None), the start included; cycles are fine.

    Where every vertex drains into one at most, as in a river network, rounds double the distance they cover, and a
    river of n hops takes log n rounds. In other graphs rounds extend a frontier by one hop and drop what has been
    seen. Each round is written to shared storage, so the plan stays short and lost executors cost one round.
    """
    spark = links.sparkSession
    forward = links.select("src", "dst").distinct()
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"out": forward, "in": backward, "all": forward.unionByName(backward).distinct()}[mode]
    base = shared_path(spark, "reach")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    first = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct()
    one_way = mode != "all" and not forward.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (_by_doubling if one_way else _by_frontier)(first, step, order, kept)


def _by_doubling(first: DataFrame, step: DataFrame, order: int | None, kept) -> DataFrame:
    """Round k joins what is known within 2^k - 1 hops with the pairs that are exactly 2^k hops apart."""
    known, jump, hops = kept(first, "known0"), kept(step, "jump0"), 1
    while order is None or hops <= order:
        far = known.join(jump, known["id"] == jump["src"]).select("start", F.col("dst").alias("id"), (F.col("hops") + hops).alias("hops"))
        far = far if order is None else far.where(F.col("hops") <= order)
        # on a cycle a vertex comes again with more hops
        new = kept(far.join(known.select("start", "id"), ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("hops").alias("hops")), f"new{hops}")
        if not new.limit(1).count():
            break
        known = kept(known.unionByName(new), f"known{hops}")
        a, b = jump.alias("a"), jump.alias("b")
        jump = kept(a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst"), f"jump{hops}")
        hops *= 2
    return known


def _by_frontier(first: DataFrame, step: DataFrame, order: int | None, kept) -> DataFrame:
    frontier = seen = kept(first, "0")
    rounds = 0
    while order is None or rounds < order:
        rounds += 1
        moved = frontier.join(step, frontier["id"] == step["src"]).select("start", F.col("dst").alias("id"), F.lit(rounds).alias("hops")).distinct()
        frontier = kept(moved.join(seen.select("start", "id"), ["start", "id"], "left_anti"), str(rounds))
        if not frontier.limit(1).count():
            break
        # what has been seen is read again in every round: as one table once in eight of them, so folders don't add up
        seen = seen.unionByName(frontier)
        if rounds % 8 == 0:
            seen = kept(seen, f"seen{rounds}")
    return seen


def neighbourhood(links: DataFrame, starts: DataFrame, mode: str = "all", order: int | None = None) -> DataFrame:
    """Edges of the subgraph that the reached vertices span, per start."""
    found = reach(links, starts, mode, order).select("start", "id")
    a = links.join(found.withColumnRenamed("id", "src"), "src")
    return a.join(found.withColumnRenamed("id", "dst"), ["start", "dst"]).select("start", "src", "dst")


def upstream(links: DataFrame, starts: DataFrame, order: int | None = None) -> DataFrame:
    return reach(links, starts, "in", order)


def downstream(links: DataFrame, starts: DataFrame, order: int | None = None) -> DataFrame:
    return reach(links, starts, "out", order)


def upstream_area(catchments: DataFrame, links: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, n, area_sqkm`` of all catchments that drain through each start, its own included."""
    found = upstream(links, starts).select("start", "id")
    return found.join(catchments.select("id", "area_sqkm"), "id").groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("area_sqkm").alias("area_sqkm"))


def vertex(data: DataFrame, id_col: str, wanted: Column) -> DataFrame:
    """The rows of the vertices with the wanted ids; a filter that reaches the scan."""
    return data.where(F.col(id_col).eqNullSafe(wanted))
