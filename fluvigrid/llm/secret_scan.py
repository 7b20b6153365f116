"""Secret scans over an incremental blob ledger.

Every historical version of every file is content-addressed; only (blob, rule version) pairs that the ledger has
not seen are scanned, and the findings of all versions are joined back to all paths. DataFrame functions only.

Positions come from cutting a text at a rule's matches: the pieces between matches and the matches themselves
give every start and end by running sums of lengths, in code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ._common import work_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` must never match the empty string. Matches whose ``judged_group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    judged_group: int = 0
    least: int = 1
    base: bool = False


#: In the order in which kinds are listed. Hexadecimal runs and access keys are maximal runs, so asking for the least
#: length inside the pattern drops the same matches; for assignments a dropped match still uses up its text.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULE_VERSION = "1"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's leftmost non-overlapping matches."""
    pattern = F.lit(rule.pattern)
    cut = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.judged_group)).alias("judged"),
    )
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")

    def walk(cut: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("i"), empty.alias("spans"))

        def step(acc: Column, match: Column) -> Column:
            start = acc["at"] + F.length(F.get(cut["between"], acc["i"]))
            end = start + F.length(match)
            span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            keep = F.length(F.get(cut["judged"], acc["i"])) >= rule.least
            more = F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.cast("long").alias("at"), (acc["i"] + 1).alias("i"), more.alias("spans"))

        return F.aggregate(cut["found"], begin, step, lambda acc: acc["spans"])

    # one element through transform(), so that the cut is computed once
    walked = F.get(F.transform(F.array(cut), walk), F.lit(0))
    return F.when(F.regexp_like(text, pattern), walked).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of (blob, text): all rules' spans by start, then kind as listed. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [spans_of(text, rule, i) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.sort_array(F.concat(*arrays)).alias("spans"))


def scan_versions(
    versions: DataFrame,
    ledger: str,
    key_cols: tuple[str, ...] = ("doc_id",),
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Scan what the ledger has not seen, extend it, and give ``key_cols, blob, spans`` for every version.

    ``versions`` has the key columns (path, commit, ...) and ``text``. ``ledger`` is a path in shared storage that
    holds one row per scanned (blob, rule_version) with its spans; it need not exist yet. A null text is the blob
    of the empty text; repeated versions and equal texts share one scan. An empty table scans nothing. A blob that
    the ledger holds twice counts once, so a retried or concurrent scan does no harm. Results of several scans of one
    ledger may be used in one plan.
    """
    spark = versions.sparkSession
    # Scanned texts are few columns wide: the blob's text goes through one exchange, copies meet before it.
    addressed = versions.select(*key_cols, F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    schema = "blob string, rule_version string, spans array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    try:
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version)
    except AnalysisException:
        seen = None
    fresh = addressed.select("blob", "text")
    if seen is not None:
        fresh = fresh.join(seen.select("blob"), "blob", "left_anti")
    fresh = fresh.groupBy("blob").agg(F.first("text").alias("text"))
    scanned = scan_blobs(fresh, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    scanned.write.mode("append").parquet(ledger)
    # Spark takes reads of one path for equal, whatever files each has listed, and would answer this one with the exchange
    # of an earlier scan, before the ledger grew; an option of its own tells them apart.
    grown = spark.read.schema(schema).option("ledgerRead", uuid.uuid4().hex).parquet(ledger)
    known = grown.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    paths = addressed.select(*key_cols, "blob")
    # a writer that was retried, or ran beside another, may have added a blob twice
    findings = known.groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.join(findings, "blob", "left").select(*key_cols, "blob", F.coalesce("spans", F.array().cast(known.schema["spans"].dataType)).alias("spans"))


def fresh_ledger(df: DataFrame) -> str:
    return work_path(df.sparkSession, "ledger")


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The digest columns of the contract."""
    base = [r.kind for r in rules if r.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(F.transform(spans, line), ",")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(join(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        join(F.col("spans")).alias("spans"),
    )
