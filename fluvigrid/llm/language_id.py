"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with single blanks where anything else stood. Hashed 1- to 3-grams of the padded
text are counted per language on a bounded, documented sample of labelled rows; the smoothed log-probability
matrix is of fixed size (2^bits rows, a column per language) and is broadcast; whole texts are scored in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, tidy

#: Labelled rows to fit on, at most: those with the smallest hashes of their id.
SAMPLE_ROWS = 4_000
BITS = 16
ORDERS = (1, 2, 3)
#: Code points scored at once; longer texts are scored piece by piece and summed.
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank: a table over all of Unicode."""
    table = np.full(0x110000, 32, np.uint32)
    for start, stop in ((0x41, 0x3000), (0x3000, 0x33480), (0xFF00, 0x1FFFF)):
        for c in range(start, stop):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def gram_buckets(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (buckets of all n-grams, which text each belongs to, whether each text has a letter)."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        joined = "".join([f" {t} " for t in texts[lo:hi]])
        code = _fold()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        owner = np.repeat(np.arange(hi - lo), np.array([len(t) for t in texts[lo:hi]]) + 2)
        blank = code == 32
        letters = np.zeros(hi - lo, bool)
        letters[owner[~blank]] = True
        keep = np.ones(len(code), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
        code, owner = code[keep], owner[keep]
        shift, grams, owners = np.uint32(32 - bits), [], []
        rolled = np.zeros(len(code), np.uint32)
        for n in ORDERS:
            if len(code) < n:
                break
            rolled = rolled[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(1)
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            inside = owner[: len(rolled)] == owner[n - 1 :]
            if n == 1:
                inside = inside & (code != 32)
            grams.append((mixed >> shift)[inside])
            owners.append(owner[: len(rolled)][inside])
        yield (np.concatenate(grams) if grams else np.zeros(0, np.uint32), np.concatenate(owners) if owners else np.zeros(0, np.int64), letters)
        lo = hi


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log-probabilities: a matrix bucket x language, and the priors."""

    langs: tuple[str, ...]
    log_gram: np.ndarray
    log_prior: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-joint per text and language, has a letter)."""
        joint, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        at, size = 0, len(self.log_gram)
        for buckets, owner, has in gram_buckets(texts, size.bit_length() - 1):
            for j in range(len(self.langs)):
                joint[at : at + len(has), j] = np.bincount(owner, self.log_gram[:, j][buckets], len(has))
            letters[at : at + len(has)] = has
            at += len(has)
        return joint + self.log_prior, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior, ties to the smaller name; ``und`` and 0 without a letter or a model."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        joint, letters = self.scores([t or "" for t in texts])
        joint -= joint.max(axis=1, keepdims=True)
        odds = np.exp(joint)
        best = odds.argmax(axis=1)
        score = odds.max(axis=1) / odds.sum(axis=1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, smoothing: float = 0.5) -> Model:
    """Fit on (doc_id, text, lang) rows with a lang and a text: at most ``sample_rows``, by hash of the id.

    Each task counts its texts' n-grams; counts meet per language and bucket, at most languages x 2^bits rows.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64(F.lit(17), "doc_id").alias("h"))
    edge = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return Model((), np.zeros((1 << bits, 0)), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                total = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for buckets, _, _ in gram_buckets(own, bits):
                    total += np.bincount(buckets, minlength=1 << bits)
        for lang, total in counts.items():
            full = np.append(np.flatnonzero(total), -1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full), pa.array(np.append(total[full[:-1]], docs[lang]))], names=["lang", "bucket", "n"])

    counted = rows.where(F.col("h") <= edge).select("text", "lang").mapInArrow(tidy(count), "lang string, bucket long, n long")
    got: pd.DataFrame = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(got["lang"].unique(), key=lambda s: s.encode()))
    table, docs = np.full((1 << bits, len(langs)), smoothing), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        docs[j] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        table[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)), np.log(docs / docs.sum()))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended; one narrow pass over whole texts.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no language was learned.
    Columns of ``docs`` with the new names are replaced; repeated rows are judged each.
    """
    bounded_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    narrow = docs.select(*[f"`{f.name}`" for f in own])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = narrow.columns.index(text_col)
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    return narrow.mapInArrow(tidy(run), schema)


def reject_unknown(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is known, all columns: those that are ``und`` or score under ``least_score`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and s >= least_score for lang, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
