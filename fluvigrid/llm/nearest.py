"""Approximate nearest neighbours as a block matrix join.

Vectors are packed into blocks of bounded size: int8 codes with a scale and the norm of what rounding lost. Query
blocks meet candidate blocks in tiles. A tile's int8 products give every inner product to within a bound. A pair
that the bounds of a task's tiles, merged in heaps, cannot rule out survives; of all survivors those that the merged
bounds cannot rule out are computed again in double precision and ranked. Tiles carry codes and four figures a vector;
the vectors themselves meet the few survivors in the end. The bounds are strict, so the result is exact: recall is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, stored, tidy

#: Rows of a block: tiles of 1,024 queries x 4,096 candidates take 32 MB in double precision.
QUERY_BLOCK = 1_024
CANDIDATE_BLOCK = 4_096
#: Candidate blocks that one task compares with a query block.
TILES = 16
_BLOCK = "dim int, block int, ids binary, codes binary, stats binary"


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and per row: scale, norm of the coded vector, norm of the rest, norm."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1  # a largest component so small that the division underflows: everything is rest
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    return codes, np.stack([scale, norm(coded), norm(vectors - coded), norm(vectors)], axis=1)


class Heaps:
    """Of one query block, over the tiles of one task: each query's k best lower bounds, and what they can't rule out."""

    def __init__(self, queries: dict[str, np.ndarray], k: int):
        self.queries, self.k = queries, k
        self.low = np.full((len(queries["ids"]), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, candidates: dict[str, np.ndarray]) -> None:
        """A tile: pairs whose upper bound reaches the query's k-th lower bound so far stay."""
        qs, cs, k = self.queries["stats"], candidates["stats"], self.k
        # products of codes are whole numbers below 2^24 for up to 1,040 components: exact in float32
        kind = np.float32 if self.queries["codes"].shape[1] <= 1040 else np.float64
        near = (self.queries["codes"].astype(kind) @ candidates["codes"].astype(kind).T).astype(np.float64)
        near *= qs[:, :1] * cs[:, 0]
        bound = (qs[:, 2:3] * cs[:, 1] + qs[:, 3:4] * cs[:, 2]) * (1 + 1e-9) + 1e-12 * qs[:, 3:4] * cs[:, 3]
        own = self.queries["ids"][:, None] == candidates["ids"]
        low = np.where(own, -np.inf, near - bound)
        best = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
        merged = np.concatenate([self.low, best], axis=1)
        self.low = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero((near + bound >= self.low.min(axis=1)[:, None]) & ~own)
        self.found.append((q, candidates["ids"][c], low[q, c], near[q, c] + bound[q, c]))

    def survivors(self) -> pa.RecordBatch:
        q, ids, low, high = (np.concatenate(x) for x in zip(*self.found, strict=True))
        left = high >= self.low.min(axis=1)[q]
        return pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (self.queries["ids"][q], ids, low, high)], names=["query_id", "vec_id", "low", "high"])


def _pack(rows: DataFrame, blocks: Column) -> DataFrame:
    """One row for each block of (id, vector) rows."""

    def pack(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        ids = table["id"].to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        flat = table["vector"].combine_chunks()
        vectors = flat.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), dim)[order]
        codes, stats = quantise(vectors)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "ids": [ids[order].tobytes()],
            "codes": [codes.tobytes()], "stats": [stats.astype("<f8").tobytes()],
        })

    keyed = rows.select("id", "vector", F.size("vector").alias("dim"), blocks.alias("block"))
    return keyed.groupBy("dim", "block").applyInArrow(pack, _BLOCK)


def _unpack(row: dict, prefix: str) -> dict[str, np.ndarray]:
    ids, dim = np.frombuffer(row[f"{prefix}ids"], "<i8"), row["dim"]
    return {
        "ids": ids,
        "codes": np.frombuffer(row[f"{prefix}codes"], np.int8).reshape(len(ids), dim),
        "stats": np.frombuffer(row[f"{prefix}stats"], "<f8").reshape(len(ids), 4),
    }


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query row with all other rows.

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components take no
    part; vectors meet those of the same length only. ``queries`` is a condition on the rows. Rows without an id
    take no part; of rows that share an id one stands for all, the one with the largest vector, component by
    component, so neighbours are distinct. A query's own row (by id) is no candidate; fewer candidates than k give
    as many rows. Other columns are not read.
    """
    bounded_batches(vectors.sparkSession)
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("query"))
    rows = stored(rows.groupBy("id").agg(F.max("vector").alias("vector"), F.max("query").alias("query")), "vectors")
    total, asked = rows.agg(F.count("*"), F.count_if("query")).first()
    n_blocks, q_blocks = max(1, -(-total // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    candidates = _pack(rows.select("id", "vector"), spread(n_blocks, 1))
    asking = _pack(rows.where("query").select("id", "vector"), spread(q_blocks, 2))
    renamed = asking.select("dim", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "stats")])
    # every query block is dealt to every candidate block of its dimension: a tile for each pair of blocks
    dealt = renamed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = candidates.join(dealt.hint("shuffle_hash"), ["dim", "block"]).withColumn("lot", F.floor(F.col("block") / TILES).cast("int"))
    lots = max(1, min(-(-n_blocks // TILES) * q_blocks, 20_000))
    tiles = tiles.repartition(lots, "dim", "q_block", "lot").sortWithinPartitions("dim", "q_block", "lot", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heaps = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (lot := (row["dim"], row["q_block"], row["lot"])) != last:
                    if heaps:
                        yield heaps.survivors()
                    last, heaps = lot, Heaps(_unpack(row, "q_"), k)
                heaps.add(_unpack(row, ""))
        if heaps:
            yield heaps.survivors()

    survivors = tiles.mapInArrow(tidy(run), "query_id long, vec_id long, low double, high double")
    # the k-th best lower bound of all tiles; without k of them nothing is ruled out
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    least = F.min(F.when(F.col("at") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    near = survivors.withColumn("at", F.row_number().over(by_low)).withColumn("least", least).where("least is null or high >= least")
    pairs = near.select("query_id", "vec_id")
    q, c = rows.where("query").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("c"))
    # summed from the first component to the last
    score = F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    scored = pairs.join(c, "vec_id").join(q, "query_id").select("query_id", "vec_id", score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
