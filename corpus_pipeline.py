"""From raw documents to a mixed, tokenized corpus: five stages, each reading what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluvigrid.llm import decontaminate, jaccard_join, language_id, mixing, token_output
from fluvigrid.llm._common import stored, table, work_path
from fluvigrid.llm.catalogue import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known, judged by text alone. Null and empty texts, and texts without a letter,
    go; repeated rows are judged each; rows without an id are judged as others are."""
    return language_id.reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the row with the smallest id; a row without an id only where the group has no
    other. Texts without a word are near none; one row stays of those that repeat id and text."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, short items as whole words. Null items and texts hold nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole; null sources are one source, ties go by id."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document from the token files, in the order of ids (null first); null texts hold the end id alone."""
    path = work_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path())
    return token_output.digest(token_output.with_starts(spark, path))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_output", tokens),
]
#: Tokenizing and language models are beyond SQL; tests compare run() with all five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
