"""Mixing sources to target weights, with exact budgets.

Documents get hash-random keys and are range-sorted by them within their source. Range buckets are cut from the
key itself, so they are even for any source, a hot one included, and need no sampling. Running sums inside a bucket
and sums over buckets give each document its prefix of words; each source is cut where its budget ends, after as
many whole epochs as the budget holds. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: float = 2) -> DataFrame:
    """``source, source_size, target`` from one row per source with its size.

    Sources by code point, null last, take the weights in turn. ``share`` times all sizes is dealt by weight; a
    target stops at ``most_epochs`` times its source's size and the excess goes to the others by weight. The
    fixpoint is found in one pass: sources by cap per weight fill up first, and the first one that the level of
    the rest does not fill ends the search. The table has a row per source, so its windows are narrow.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(rest).alias("left_weight"),
    ).withColumn("level", F.col("left") / F.col("left_weight"))
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)
    return levels.withColumn("final", level["level"]).select(
        "source", "source_size", F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with ``doc_id, source, size, source_size, target, taken``, and the columns in ``keep``.

    ``taken`` counts the words that the mix takes, repeats included: whole epochs of the source, then the documents
    in key order until the budget floor(target) ends, the last one in part. So a source's ``taken`` adds up to
    floor(target) exactly. Null texts have size 0 and nothing is taken of them; null sources form one source;
    repeated ids share a key and go by size. An empty table gives no rows.
    """
    # whole texts are read once for their sizes, which are then a small table
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep), "sizes")
    buckets = max(1, sized.count() // ROWS_PER_BUCKET)
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long")
    keyed = sized.withColumn("key", key).withColumn("bucket", bucket)
    # a running sum within (source, bucket); null-safe keys, as sources may be null
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumn("upto", F.sum("size").over(inside))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    across = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("words").over(across), F.lit(0)).alias("base"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_epochs)
    plan = bases.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "base", "source_size", "target")
    r, p = running.alias("r"), plan.alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor("target").cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("base") + F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "r.source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *keep)


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, whole texts, with the columns of ``docs``: each as often as the mix takes it.

    A document whose share is cut is kept for that round where at least half of it is taken; documents without
    words are kept once, as they cost nothing. Rows are told apart by id, source and text, nulls included; equal rows
    come as often as the mix takes them together.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")
    keyed = docs.select(row.alias("mix_row"), F.struct("*").alias("doc"))
    rounds = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).cast("int")
    mixed = mix_sources(docs.select("doc_id", "source", "text", row.alias("mix_row")), keep=("mix_row",), **options)
    times = mixed.groupBy("mix_row").agg(F.sum(rounds).cast("int").alias("rounds")).where("rounds > 0")
    one = keyed.groupBy("mix_row").agg(F.first("doc").alias("doc"))
    kept = one.join(times, "mix_row").select("doc", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    return kept.select("doc.*")
