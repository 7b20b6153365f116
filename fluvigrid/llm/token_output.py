"""Token ids as Parquet: list columns, controlled row groups, page indexes, selective reads.

Documents are range-partitioned and sorted by id, tokenized in place and written by Spark's Parquet writer: format
version 2, the id list dictionary-encoded, metadata columns delta-encoded, bounded row groups and pages. The writer
adds column and offset indexes, so reading some documents or only the metadata touches few pages.

A text is encoded word by word through a memo: the tokenizer's normaliser and splitter never join across an ASCII
blank, so the ids of a text are the ids of its words, one after another. Every word unknown to the memo goes
through the tokenizer itself, or straight to its model where the normaliser and splitter have nothing to do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, tidy

END_ID = 1
#: Words that a worker remembers; beyond it the memo starts anew. About 200 bytes each.
MEMO_WORDS = 400_000
#: New words encoded in one call.
JOINED_WORDS = 256
#: Characters encoded together, so that a batch stays small however long texts are.
BATCH_CHARS = 2_000_000
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "compression": "zstd",
}
#: Between new words that are encoded together: a control character, which is one id and part of no other.
SEPARATOR = "\x01"


#: Kinds of the first 256 characters: a for letters and digits, blank, point for . and , and x for other marks.
_KINDS = bytes(ord("a" if chr(c).isalnum() else " " if chr(c) in " \t\n\r" else "." if chr(c) in ".," else "x") for c in range(256))


def folded(text: str) -> str:
    """The text with fewer different words and the same ids: lower case, commas and full stops on their own, blanks.

    The tokenizer lower-cases, special tokens apart, which hold ``<|``. It takes a run of marks as one word, so marks
    are parted from words only in texts where none stands beside another. Texts with characters beyond the first
    256, whose lower case may differ from Python's, stay as they are.
    """
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        kinds = b".."
    if kinds != b".." and "<|" not in text:
        text = text.lower()
    if not (b".." in kinds or b".x" in kinds or b"x." in kinds):
        text = text.replace(",", " , ").replace(".", " . ")
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _byte_letters() -> dict[int, str]:
    """The letters that the byte-level splitter writes for bytes: printable ones for themselves, 256 upwards for the rest."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Texts to little-endian uint32 ids, through a memo of words that a batch looks up once for each different word."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with the end id, how many; all ids one after another)."""
        words = pc.split_pattern(pa.array([folded(t) for t in texts], pa.string()), " ")
        coded = words.values.dictionary_encode()
        known = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        known.append(np.array([end_id], "<u4").tobytes())
        ends = words.offsets.to_numpy()[1:]
        word = np.insert(coded.indices.to_numpy(), ends, len(known) - 1)
        ids = pa.array(known, pa.large_binary()).take(pa.array(word))
        _, offsets, data = ids.buffers()
        stops = np.frombuffer(offsets, np.int64, len(ids) + 1)[ends + np.arange(1, len(ends) + 1)] // 4
        return np.diff(stops, prepend=0), np.frombuffer(data, "<u4", stops[-1])

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words. A full memo starts anew with these."""
        known = list(map(self.memo.get, words))
        missing = [i for i, k in enumerate(known) if k is None]
        new = [words[i] for i in missing]
        learned = self._learn(new)
        for i, k in zip(missing, learned, strict=True):
            known[i] = k
        if len(self.memo) + len(new) <= MEMO_WORDS:
            self.memo.update(zip(new, learned, strict=True))
        elif len(words) <= MEMO_WORDS:
            self.memo = dict(zip(words, known, strict=True))
        return known

    def _learn(self, new: list[str]) -> list[bytes]:
        """Encode words. One of lower-case letters of the first 256 characters passes the normaliser unchanged, and the
        splitter parts it only from the ASCII marks at its end, which stay together; so both go to the tokenizer's
        model. Other words take the whole way, many at once."""
        out = [b""] * len(new)
        rest, tokenize, letters = [], self.model.tokenize, self.letters
        for i, word in enumerate(new):
            head = word if word.isalpha() else word.rstrip(punctuation)
            if head.isascii():
                plain = head if not head or head.isalpha() and head.islower() else None
            else:
                plain = head.encode("utf-8").decode("latin-1").translate(letters) if max(head) < "\u0100" and head.isalpha() and head == head.lower() else None
            if plain is None:
                rest.append(i)
                continue
            ids = [x.id for x in tokenize(plain)] if plain else []
            if len(head) < len(word):
                ids += [x.id for x in tokenize(word[len(head) :])]
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        for i in rest:
            if SEPARATOR in new[i]:
                out[i] = np.array(self.tokenizer.encode(new[i], add_special_tokens=False).ids, "<u4").tobytes()
        rest = [i for i in rest if SEPARATOR not in new[i]]
        joined = f" {SEPARATOR} "
        for at in range(0, len(rest), JOINED_WORDS):
            part = rest[at : at + JOINED_WORDS]
            (got,) = self.tokenizer.encode_batch_fast([joined.join(new[i] for i in part)], add_special_tokens=False)  # ids without offsets
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            raw = ids.tobytes()
            for i, lo, hi in zip(part, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)], strict=True):
                out[i] = raw[lo:hi]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _grouped(docs: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= most_chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(docs):
        yield lo, len(docs)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, shard, shard_start, n_tokens, ids`` in ascending doc_id order over the shards (null ids first).

    ``shard_start`` counts the ids of the shard's documents before this one. Null texts count as empty and hold
    the end id alone; rows that share an id go by their text's hash, so reruns agree. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, start = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _grouped(texts, BATCH_CHARS):
                counts, ids = enc.encode(texts[lo:hi], end_id)
                offsets = np.concatenate(([0], np.cumsum(counts)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(counts), lists]
                start += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    bounded_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(tidy(run), f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    encode_documents(docs, tokenizer_path, end_id).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "shard", "shard_start", "n_tokens", "ids"), between: tuple[int, int] | None = None) -> DataFrame:
    """Some columns of some documents; both choices reach the scan (row groups and pages are skipped by doc_id)."""
    rows = spark.read.parquet(path)
    if between is not None:
        rows = rows.where(F.col("doc_id").between(*between))
    return rows.select(*columns)


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` with the global start: sums of shards, a running sum over them, shard_start.

    The running sum has one row for each shard, that is for each writing task.
    """
    sums = read_tokens(spark, path, ("shard", "n_tokens")).groupBy("shard").agg(F.sum("n_tokens").alias("words"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    return read_tokens(spark, path).join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of the contract: the ids become an unsigned CRC-32 of their little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy()
            values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
