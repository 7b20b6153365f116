"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most e edits leaves one of its e + 1 pieces intact there. Pieces are
found exactly by one automaton over each whole document; around every hit the whole item is verified with Myers'
bit-parallel edit distance. Texts are compared in a normal form: lower case, runs of other characters than
letters and digits as one blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, stored, tidy

#: Edits allowed for each character of a test item.
ERROR_RATE = 0.07
#: Items whose normal form is shorter are no evidence in the middle of a word or with an edit: they must occur as they are, as whole words.
LEAST_CHARS = 40
#: Items are broadcast in blocks of about so many characters, one block after another; each is one pass over the documents.
BLOCK_CHARS = 4 << 20
_OTHER = re.compile(r"[\W_]+")


_LATIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def normal_form(text: str | None) -> str:
    try:  # texts of the first 256 code points go through a byte table, to the same effect
        folded = (text or "").encode("latin-1").translate(_LATIN).decode("latin-1")
        return " ".join([w for w in folded.split(" ") if w])
    except UnicodeEncodeError:
        return _OTHER.sub(" ", text.lower()).strip(" ")


def myers_best(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a substring of the text, where the first such substring ends)."""
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best, end


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item cut into errors + 1 pieces of even length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


@dataclass(frozen=True)
class Matcher:
    """The items of one block: (id, normal form) with the error rate and the length from which it holds."""

    items: tuple[tuple[int, str], ...]
    rate: float
    least_chars: int = LEAST_CHARS

    def errors(self, item: str) -> int:
        return int(len(item) * self.rate) if len(item) >= self.least_chars else 0

    def short_match(self, item: str, text: str, starts: list[int]) -> int | None:
        """The first of ``starts`` where the item stands as whole words."""
        for s in sorted(starts):
            if (s == 0 or text[s - 1] == " ") and text[s + len(item) : s + len(item) + 1] in ("", " "):
                return s
        return None

    def automaton(self):
        import ahocorasick

        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in pieces(text, self.errors(text)):
                where.setdefault(piece, []).append((k, offset))
        found = ahocorasick.Automaton()
        for piece, uses in where.items():
            found.add_word(piece, (len(piece), tuple(uses)))
        if where:
            found.make_automaton()
        masks = []
        for _, text in self.items:
            mask: dict[str, int] = {}
            for i, c in enumerate(text):
                mask[c] = mask.get(c, 0) | 1 << i
            masks.append(mask)
        return found if where else None, masks

    def matches(self, text: str, compiled) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best occurrence of each item that the text holds, by item id.

        Hits of an item whose windows overlap are verified once, over the union of their windows.
        """
        found, masks = compiled
        if found is None or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (length, uses) in found.iter(text):
            for k, offset in uses:
                starts.setdefault(k, []).append(end + 1 - length - offset)
        out = []
        for k, at in starts.items():
            item_id, item = self.items[k]
            errors = self.errors(item)
            if len(item) < self.least_chars:
                if (s := self.short_match(item, text, at)) is not None:
                    out.append((item_id, 0, s, s + len(item)))
                continue
            best = None
            lo = hi = None
            for s in [*sorted(at), None]:
                if lo is not None and (s is None or s - errors > hi):
                    window = text[max(0, lo) : hi]
                    distance, end = myers_best(item, masks[k], window)
                    if distance <= errors and (best is None or distance < best[1]):
                        stop = max(0, lo) + end
                        best = (item_id, distance, max(0, stop - len(item) - distance), stop)
                    lo = None
                if s is not None:
                    lo, hi = (s - errors if lo is None else lo), s + len(item) + errors
            if best:
                out.append(best)
        return sorted(out, key=lambda m: (m[0] is not None, *m) if m[0] is not None else (False, 0, *m[1:]))


@lru_cache(maxsize=1)
def _compiled(matcher: Matcher):
    return matcher.automaton()


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, start, end``: every (document, item) with an occurrence within the error budget.

    Positions are in the normal form. Items whose normal form is shorter than ``least_chars`` are searched without
    edits, as whole words; null or empty documents and items match nothing; repeated documents are reported each,
    repeated items once; null ids stay null. An empty benchmark or document table gives no rows. The benchmark's
    blocks are searched one after another, so no task or driver holds more than one.
    """
    bounded_batches(docs.sparkSession)
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("distance", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    item_kind = pa.int64() if isinstance(item_type, T.LongType) else None

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            compiled = _compiled(matcher)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(normal_form(t), compiled)]
                kinds = [batch.schema.field(0).type, item_kind, pa.int32(), pa.int64(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)

    found = [out for _, out in _over_blocks(benchmark, rate, least_chars, lambda shared, _: searched(shared))]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def _over_blocks(benchmark: DataFrame, rate: float, least_chars: int, search) -> Iterator[tuple[int, DataFrame]]:
    """(block, search(broadcast matcher, block)) for blocks of the items; all but the last result are stored and their broadcast dropped."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_CHARS)
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    if n_blocks > 1:
        items = stored(items.withColumn("block", block_of), "items")
    for block in range(n_blocks):
        part = (items.where(F.col("block") == block) if n_blocks > 1 else items).collect()
        known = [(r.item_id, n) for r in part if (n := normal_form(r.text))]
        shared = benchmark.sparkSession.sparkContext.broadcast(Matcher(tuple(sorted(known, key=str)), rate, least_chars))
        out = search(shared, block)
        if block < n_blocks - 1:
            out = stored(out, "leaks")
            shared.destroy()
        yield block, out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """One row per contaminated document: ``doc_id, n_items, distance`` (the smallest) and ``item_ids``."""
    leaks = find_leaks(docs, benchmark, **options)
    return leaks.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.min("distance").alias("distance"), F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without an occurrence of a benchmark item, all columns; narrow passes, no shuffle.

    Null and empty texts hold nothing and stay; repeated rows are judged each; an empty benchmark drops nothing.
    """
    bounded_batches(docs.sparkSession)
    at, left = docs.columns.index("text"), docs

    def kept(shared, _: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            compiled = _compiled(matcher)
            for batch in batches:
                clean = [not matcher.matches(normal_form(t), compiled) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return left.mapInArrow(tidy(run), docs.schema)

    for _, left in _over_blocks(benchmark, rate, least_chars, kept):
        pass
    return left
