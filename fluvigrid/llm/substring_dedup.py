"""Exact substring dedup by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes. Sorting all suffixes of a
corpus is not needed for that: each window of ``length`` bytes holds the leftmost smallest hashed ``core``-gram as an
anchor, and equal windows hold equal anchors at equal places. So suffixes are sorted only where anchors repeat:

1. Each document gives its anchors, with hashes of the anchor's core (the key) and of its whole context, that is all
   bytes that windows around it can reach. Prefix polynomial hashes give every hash by one subtraction.
2. Equal contexts meet by hash: all their windows are repeated. Only keys with different contexts need a sort, and
   one copy of each context is sent there, however often it occurs.
3. Keys with more contexts than one task should sort are split as a quicksort of suffixes does: every context is
   compared with a pivot, byte by byte. What it shares with the pivot is settled; another context can only share
   more with it if it leaves the pivot at the same byte, before the anchor or after it. Those are its next groups.
4. Within a group the suffixes that start at the anchor, and the reversed ones that end there, are merge-sorted;
   common extensions are found by binary search over prefix hashes and then checked byte by byte. Neighbours'
   extensions give, for each window, the classes of equal left and right parts; windows whose two classes occur
   together twice are repeated.
5. All windows around an anchor hold it, so what the repeated ones cover is one run. Runs go back to all anchors of
   their context and are united per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, membership, mix64, stored, tidy

LENGTH = 400
CORE = 64
#: Bytes hashed together; longer documents are cut into pieces that overlap by what their windows need.
BUFFER = 1 << 18
#: Contexts sorted together, and contexts compared with a pivot in one task.
SORT_ROWS = 2_048
PIVOT_ROWS = 4_096
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for out, b in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
            out[0] = 1
            out[1:] = np.uint64(b)
            np.multiply.accumulate(out, out=out)
    return up, down


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] of the first i bytes along the last axis; ``span_hash`` takes a difference."""
    up, _ = _powers(BUFFER + 4 * LENGTH)
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_letters()[data] * up[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = _powers(BUFFER + 4 * LENGTH)
    with np.errstate(over="ignore"):
        return (prefix[hi] - prefix[lo]) * down[lo]


def window_minima(packed: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(packed)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = packed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window_from: np.ndarray, window_to: np.ndarray, length: int, core: int):
    """(piece, position, key, context hash) of the anchors of windows that start in [window_from, window_to) of each piece.

    ``data`` holds the pieces; piece i is data[starts[i]:ends[i]], and contexts do not leave it.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - core + 1)
    hashed = mix64(span_hash(prefix, at, at + core))
    packed = (hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    minima = window_minima(packed, length - core + 1)
    mark = np.zeros(len(data) + 1, np.int8)
    has = window_to > window_from
    np.add.at(mark, window_from[has], 1)
    np.add.at(mark, window_to[has], -1)
    wanted = np.cumsum(mark)[: len(minima)] > 0
    pos = np.unique((minima[wanted] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    piece = np.searchsorted(starts, pos, side="right") - 1
    left = np.minimum(pos - starts[piece], length - core)
    right = np.minimum(ends[piece] - pos, length)
    with np.errstate(over="ignore"):
        context = mix64(span_hash(prefix, pos - left, pos + right) + mix64((left * 4096 + right).astype(np.uint64)))
    return piece, pos, mix64(hashed[pos] + np.uint64(core)), context


def _pieces(docs: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, tuple[np.ndarray, ...]]]:
    """Buffers of whole documents, or of a piece of a long one: (document, offset of its data) of each, data, bounds."""
    held: list[tuple[int, int, bytes, int, int]] = []
    size = 0

    def build():
        lengths = np.array([len(h[2]) for h in held], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        w0, w1 = np.array([h[3] for h in held]), np.array([h[4] for h in held])
        return [(h[0], h[1]) for h in held], np.frombuffer(b"".join(h[2] for h in held), np.uint8), (starts, starts + lengths, starts + w0, starts + w1)

    for i, doc in enumerate(docs):
        if len(doc) < length:
            continue
        if len(doc) > BUFFER // 2:
            step = BUFFER // 2
            for s in range(0, len(doc) - length + 1, step):
                a = max(0, s - length)
                b = min(len(doc), s + step + 2 * length)
                held_one = (i, a, doc[a:b], s - a, min(s + step, len(doc) - length + 1) - a)
                if held:
                    yield build()
                held, size = [held_one], 0
                yield build()
                held = []
            continue
        if size + len(doc) > BUFFER and held:
            yield build()
            held, size = [], 0
        held.append((i, 0, doc, 0, len(doc) - length + 1))
        size += len(doc)
    if held:
        yield build()


def find_anchors(docs: DataFrame, length: int, core: int) -> DataFrame:
    """``doc_id, tag, pos, key, ctx``, once per row and place; the tag is a hash of the text, which tells rows with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            last, known = -1, np.zeros(0, np.int64)
            for owners, data, (starts, ends, w0, w1) in _pieces(raw, length):
                piece, pos, key, ctx = anchors(data, starts, ends, w0, w1, length, core)
                doc = np.array([o[0] for o in owners])[piece] if len(piece) else piece
                at = pos + (np.array([o[1] for o in owners]) - starts)[piece] if len(piece) else piece
                if len(owners) == 1:  # a piece of a long document finds anchors at its beginning again
                    new = ~np.isin(at, known) if owners[0][0] == last else np.ones(len(at), bool)
                    last, known = owners[0][0], at
                    doc, at, key, ctx = doc[new], at[new], key[new], ctx[new]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))],
                    names=["doc_id", "tag", "pos", "key", "ctx"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tag", "text").mapInArrow(tidy(run), f"doc_id {kind}, tag int, pos long, key long, ctx long")


class Suffixes:
    """Rows of bytes (already reversed for left parts) with prefix hashes, sorted within groups."""

    def __init__(self, rows: list[bytes], groups: np.ndarray):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        width = max(1, int(self.lengths.max(initial=0)))
        self.data = np.zeros((len(rows), width), np.uint8)
        for i, r in enumerate(rows):
            self.data[i, : len(r)] = np.frombuffer(r, np.uint8)
        self.prefix = prefix_hashes(self.data)
        self.groups = groups

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extensions of pairs of rows: binary search for the longest equal prefix hash."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.lengths[a], self.lengths[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row a sorts before row b: by group, then bytes, then row number."""
        common = self.extension(a, b)
        la, lb = self.lengths[a], self.lengths[b]
        last = self.data.shape[1] - 1
        ca = np.where(common < la, self.data[a, np.minimum(common, last)].astype(np.int64), -1)
        cb = np.where(common < lb, self.data[b, np.minimum(common, last)].astype(np.int64), -1)
        ga, gb = self.groups[a], self.groups[b]
        return (ga < gb) | ((ga == gb) & ((ca < cb) | ((ca == cb) & (a < b))))

    def sort(self) -> np.ndarray:
        """Merge sort, all merges of a level at once: an element's place is its own rank plus its rank in the sibling run."""
        n = len(self.lengths)
        order = np.arange(n)
        run = 1
        while run < n:
            place = np.arange(n)
            start = place // run * run
            right = (place // run) % 2 == 1
            sibling = np.where(right, start - run, start + run)
            low, high = np.minimum(sibling, n), np.minimum(sibling + run, n)
            first = low.copy()
            while (low < high).any():
                middle = (low + high) // 2
                probe = np.minimum(middle, n - 1)
                below = self.less(order[probe], order) & (low < high)
                open_ = low < high
                low = np.where(open_ & below, middle + 1, low)
                high = np.where(open_ & ~below, middle, high)
            target = np.where(right, start - run, start) + (place - start) + (low - first)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, run = merged, 2 * run
        return order

    def sorted_extensions(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension with the row before), checked byte by byte; on a hash collision the bytes decide."""
        order = self.sort()
        found = self._neighbours(order)
        if len(order) > 1 and not np.array_equal(found[1:], np.where(self.groups[order[1:]] == self.groups[order[:-1]], self.extension(order[:-1], order[1:]), 0)):
            keys = [(self.groups[i], self.data[i, : self.lengths[i]].tobytes()) for i in range(len(order))]
            order = np.array(sorted(range(len(order)), key=keys.__getitem__))
            found = self._neighbours(order)
        return order, found

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        for lo in range(1, len(order), 4096):
            a, b = order[lo - 1 : lo + 4095][: len(order[lo : lo + 4096])], order[lo : lo + 4096]
            least = np.minimum(self.lengths[a], self.lengths[b])
            differ = self.data[a] != self.data[b]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
            out[lo : lo + 4096] = np.where(self.groups[a] == self.groups[b], np.minimum(first, least), 0)
        return out

    def classes(self, order: np.ndarray, extensions: np.ndarray, depth: int) -> np.ndarray:
        """Rows that agree in their first ``depth`` bytes get one number; shorter rows get -1."""
        number = np.cumsum(extensions < depth) if depth else np.cumsum(np.concatenate(([True], self.groups[order[1:]] != self.groups[order[:-1]])))
        out = np.empty(len(order), np.int64)
        out[order] = number
        out[self.lengths < depth] = -1
        return out


def repeated_runs(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) relative to the anchor: what windows repeated within a group cover. Rows of a group differ."""
    right, left = Suffixes(rights, groups), Suffixes([x[::-1] for x in lefts], groups)
    (ro, re), (lo, le) = right.sorted_extensions(), left.sorted_extensions()
    n = len(groups)
    first, last = np.full(n, -1), np.full(n, -1)
    for back in range(length - core + 1):  # windows that begin so many bytes before the anchor
        a, b = left.classes(lo, le, back), right.classes(ro, re, length - back)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        both = a[ok] * (n + 1) + b[ok]
        order = np.argsort(both, kind="stable")
        both = both[order]
        same = both[1:] == both[:-1]
        twice = np.zeros(len(both), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = ok[order[twice]]
        first[found] = np.where(first[found] < 0, back, first[found])
        last[found] = back
    rows = np.flatnonzero(last >= 0)
    return rows, -last[rows], length - first[rows]


def common_runs(pivot: tuple[bytes, bytes], lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each context shares with the pivot before the anchor, and from it on."""
    out = []
    for own, rows in ((pivot[0][::-1], [x[::-1] for x in lefts]), (pivot[1], rights)):
        width = max([1, len(own), *map(len, rows)])
        table = np.full((len(rows), width), 256, np.uint16)
        for i, r in enumerate(rows):
            table[i, : len(r)] = np.frombuffer(r, np.uint8)
        one = np.full(width, 257, np.uint16)
        one[: len(own)] = np.frombuffer(own, np.uint8)
        differ = table != one
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1), width))
    return out[0], out[1]


def split_groups(members: DataFrame, length: int) -> DataFrame:
    """One step of the quicksort over groups (g, key, ctx, n, before, after) too large to sort: computed and stored.

    Rows of kind 0 are runs ``key, ctx, lo, hi`` that a context, or the pivot, shares with the other; rows of kind 1
    name in ``lo`` a group of the next step for (key, ctx).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: tuple[int, int, tuple[bytes, bytes]] | None = None
        for batch in batches:
            g, role, key, ctx, before, after = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(i for i in range(1, len(g)) if role[i] == 0), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if role[a] == 0:
                    pivot, a = (g[a], ctx[a], (before[a], after[a])), a + 1
                assert pivot is not None
                if a == b:
                    continue
                left, right = common_runs(pivot[2], before[a:b], after[a:b])
                rows = []
                good = np.flatnonzero(left + right >= length)
                if len(good):
                    rows.append((0, key[a], pivot[1], -int(left[good].max()), int(right[good].max())))
                for i in range(a, b):
                    x, y = int(left[i - a]), int(right[i - a])
                    if x + y >= length:
                        rows.append((0, key[i], ctx[i], -x, y))
                    for side, shared, text in ((1, x, before[i][::-1]), (2, y, after[i])):
                        if shared < len(text):
                            name = np.array([((g[i] * 0x9E3779B97F4A7C15 + side) ^ (shared << 8 | text[shared]) * 0xD6E8FEB86659FD93) & (1 << 64) - 1], np.uint64)
                            rows.append((1, key[i], ctx[i], int(mix64(name).view(np.int64)[0]), 0))
                if rows:
                    kind, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), *(pa.array(c, pa.int64()) for c in rest)], names=["kind", "key", "ctx", "lo", "hi"])

    pivots = members.groupBy("g", "n").agg(F.min(F.struct("ctx", "before", "after")).alias("p"))
    chunks = F.ceil(F.col("n") / PIVOT_ROWS)
    sent = pivots.select("g", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)).alias("chunk"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("key"), "p.ctx", "p.before", "p.after")
    others = members.join(pivots.select("g", F.col("p.ctx").alias("own")), "g").where("ctx <> own")
    dealt = others.select("g", F.pmod(F.xxhash64("ctx"), chunks).cast("int").alias("chunk"), F.lit(1).alias("role"), "key", "ctx", "before", "after")
    ordered = sent.unionByName(dealt).repartition("g", "chunk").sortWithinPartitions("g", "chunk", "role")
    return stored(ordered.select("g", "role", "key", "ctx", "before", "after").mapInArrow(tidy(run), "kind byte, key long, ctx long, lo long, hi long"), "split")


def sort_groups(members: DataFrame, length: int, core: int) -> DataFrame:
    """``key, ctx, lo, hi`` of groups (g, key, ctx, before, after): partitions hold whole groups, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes, bytes]] = {}

        def flush() -> pa.RecordBatch:
            groups = np.array([g for g, _ in held], np.int64)
            ctx = np.array([c for _, c in held], np.int64)
            key = np.array([x[0] for x in held.values()], np.int64)
            rows, lo, hi = repeated_runs(groups, [x[1] for x in held.values()], [x[2] for x in held.values()], length, core)
            return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ctx[rows]), pa.array(lo), pa.array(hi)], names=["key", "ctx", "lo", "hi"])

        last = None
        for batch in batches:
            for g, key, ctx, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= SORT_ROWS and g != last:
                    yield flush()
                    held.clear()
                last = g
                held[g, ctx] = (key, before, after)
        if held:
            yield flush()

    dealt = members.select("g", "key", "ctx", "before", "after").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(tidy(run), "key long, ctx long, lo long, hi long")


def _shared_runs(cut: DataFrame, length: int, core: int) -> list[DataFrame]:
    """``key, ctx, lo, hi``: runs that different contexts (key, ctx, n, before, after) of a key have in common.

    ``n`` counts the contexts of the key; only groups too large to sort are written again.
    """
    out = []
    members = cut.withColumn("g", F.col("key"))
    hot = members.where(F.col("n") > SORT_ROWS).select("key", "ctx", "before", "after")
    while True:
        out.append(sort_groups(members.where(F.col("n") <= SORT_ROWS), length, core))
        large = members.where(F.col("n") > SORT_ROWS)
        if not large.limit(1).count():
            return out
        split = split_groups(large, length)
        out.append(split.where("kind = 0").select("key", "ctx", "lo", "hi"))
        groups = split.where("kind = 1").select(F.col("lo").alias("g"), "key", "ctx")
        sizes = groups.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        members = stored(groups.join(sizes, "g").join(hot, ["key", "ctx"]), "members")


def _cut_contexts(wanted: DataFrame, docs: DataFrame, length: int, core: int) -> DataFrame:
    """``key, ctx, n, before, after``: the bytes around one occurrence of each wanted context."""
    places = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "key", "ctx", "n")).alias("places"))
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    places = stored(places, "places")
    d, w = membership(places, "doc_id")(docs.select("doc_id", "tag", "text"), "doc_id").where("_member").alias("d"), places.alias("w")
    texts = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tag") == F.col("w.tag"))).select(raw.alias("raw"), F.explode("places").alias("p"))
    reach = F.least(F.col("p.pos"), F.lit(length - core)).cast("int")
    at = F.col("p.pos").cast("int")
    return texts.select("p.key", "p.ctx", "p.n", F.col("raw").substr(at - reach + F.lit(1), reach).alias("before"), F.col("raw").substr(at + F.lit(1), F.lit(length)).alias("after"))


def repeated(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id, tag, spans``: for each document with repeated strings the byte spans that they cover (not united)."""
    found = stored(find_anchors(docs, length, core), "anchors")
    place = F.struct("doc_id", "tag", "pos")
    contexts = found.groupBy("key", "ctx").agg(F.min(place).alias("one"), F.count("*").alias("times"))
    contexts = stored(contexts.select("key", "ctx", "one", (F.col("times") > 1).alias("twice")), "contexts")
    keys = contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = contexts.join(keys, "key").select("key", "ctx", "n", "one.*")
    cut = stored(_cut_contexts(wanted, docs, length, core), "cut")
    whole = contexts.where("twice").select("key", "ctx", F.lit(core - length).cast("long").alias("lo"), F.lit(length).cast("long").alias("hi"))
    runs = reduce(DataFrame.unionByName, _shared_runs(cut, length, core), whole)
    covered = stored(runs.groupBy("key", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "covered")
    moved = F.struct(F.greatest(F.lit(0), F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    here = found.join(covered, ["key", "ctx"]).select("doc_id", "tag", moved.alias("s"))
    return here.groupBy("doc_id", "tag").agg(F.collect_set("s").alias("spans"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: each document's removed runs (disjoint, sorted) and the bytes that stay.

    Strings are judged on the input; matches never cross documents and overlaps count, within a document too. Null
    and empty texts have no bytes and nothing removed; documents shorter than ``length`` stay whole; of equal
    documents every copy goes. Every row is a document, whatever its id: equal rows repeat each other. Ids may be null.
    Very long texts are searched in pieces, whole. An empty table gives no rows; extra columns are not read.

    Contexts that agree in full are matched by two 64-bit hashes; those that differ are compared byte by byte.
    """
    bounded_batches(docs.sparkSession)
    tagged = docs.select("doc_id", "text", F.hash("text").alias("tag"))
    spans = stored(repeated(tagged, length, core), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["lo"], min(s["hi"], len(raw))) for s in found or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for m in merged for x in m), len(raw)]
                sizes.append(len(raw))
                runs.append([{"lo": a, "hi": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = membership(spans, "doc_id")(tagged, "doc_id")
    t, s = marked.where("_member").alias("t"), spans.alias("s")
    joined = t.join(s, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.tag") == F.col("s.tag")), "left").select("t.doc_id", "t.text", "s.spans")
    untouched = marked.where("not _member").select("doc_id", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"))
    return joined.unionByName(untouched).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The digest columns of the contract, and whether the document held a repeat."""
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    return removed.select("doc_id", "n_bytes", width.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("repeated"))
