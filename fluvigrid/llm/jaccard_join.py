"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with equal shingle sets form one class, so copies cost one entry however many they are. Shingles are put
in an order that a fixed-size count sketch makes rare-first as far as it can; every class hands out a prefix of its
shingles, longer than a link needs, so that classes that link share several. Where those meet they are counted
exactly, and each class keeps the rarest of its shared ones, as few as must hold one that any partner keeps too.

Classes with one kept shingle in common, of neighbouring size bands, are a group. A small group is expanded into
pairs, which pass the length and positional filters and are verified once, with the suffix filter. A larger one is
not: its hub, the member that shares most, is intersected with every other one. Members that link with the hub are
one component. If x does not, then what x has in common with any partner cannot all lie in the hub, unless both hold
as much of the hub as a link of their sizes takes. So x's partners share one of the rarest shingles that x has
outside the hub: those shingles make the next round's groups, and the few members that hold that much of the hub make
one more. A family of near copies below the threshold costs as many tests as it has members, not as pairs. Rounds
end when no group has two components; the size up to which groups are expanded grows fourfold with each round.

Sets are held as 64-bit hashes of shingles, in the verification too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, membership, mix64, small_batches, stored, tidy
from .components import components

SKETCH_BITS = 22
SKETCH_SLICES = 16
#: Entries that a mapper holds before it hands them out to buckets, and documents for each bucket.
FLUSH_ENTRIES = 250_000
DOCS_PER_BUCKET = 2_048
#: Classes of one shingle that meet in one bucket; beyond it (by the sketch) they are dealt over several.
HOT_CLASSES = 20_000
#: The share of the least overlap by which prefixes are longer than one common shingle needs.
EXTRA = 0.06
#: Groups of at most so many members are expanded in the first round; four times as many in each that follows.
SMALL_GROUP = 8
#: Members of a star that are tested in one task.
STAR_CHUNK = 1_000
#: Texts that a Python worker holds at once.
VERIFY_ROWS, VERIFY_BYTES = 128, 4 << 20
_ENTRY = np.dtype([("t", "<u8"), ("s", "<i8"), ("n", "<i4"), ("p", "<i4")])
_SALT = 0xD6E8FEB86659FD93


_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed together, at most, unless one text is longer; such a text is hashed alone.
BUFFER = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its random code, A-Z as a-z, and whether it parts words: a blank or a control from 9 to 13."""
    folded = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)
    return mix64(folded + np.uint64(1)), np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(BUFFER + 2, _BASE, np.uint64), np.full(BUFFER + 2, pow(_BASE, -1, 1 << 64), np.uint64)
    with np.errstate(over="ignore"):
        for x in (up, down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
    return up, down


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a buffer of at most BUFFER bytes, by prefix polynomial hashes."""
    codes, blank = _letters()
    up, down = _powers()
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = blank[data]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * up[: len(data)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length: pieces are cut at blanks; a word longer than a piece is hashed by itself."""
    if len(raw) <= BUFFER:
        return _hash_words(np.frombuffer(raw, np.uint8))[0]
    out = []
    for word in raw.split():
        out.append(_hash_words(np.frombuffer(word, np.uint8))[0] if len(word) <= BUFFER else np.array([xxhash.xxh64_intdigest(word.lower())], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fold(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` neighbours."""
    n = max(0, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            total = (total + h[k : k + n]) * np.uint64(_BASE)
            total ^= total >> np.uint64(29)
        return mix64(total + np.uint64(words))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's word shingles; a shorter text is one shingle, none is empty."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and size + len(raw[hi]) + 1 <= BUFFER:
            size += len(raw[hi]) + 1
            hi += 1
        if hi == lo:
            hashes, cuts = _word_hashes(raw[lo]), None
            cuts = [0, len(hashes)]
            hi = lo + 1
        else:
            hashes, starts = _hash_words(np.frombuffer(b" ".join(raw[lo:hi]), np.uint8))
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[lo:hi])])).tolist()
        runs = _fold(hashes, words)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(runs[a : b - words + 1]))
            else:
                out.append(_fold(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        lo = hi
    return out


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles) & 0xFFFFFFFF) - (1 << 63)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def least_partner(n: int, percent: int) -> int:
    """The size of the smallest set that can link with one of size n, and the least overlap with any set."""
    return -(-percent * n // 100)


def surplus(n: int, percent: int) -> int:
    """How many shingles the prefixes of two sets that link have in common, at least, if n is the smaller size."""
    return max(1, int(EXTRA * least_partner(n, percent)))


def prefix_length(n: int, percent: int) -> int:
    """Of the common shingles the j-th, from 0, comes at n - least_partner(n) + j at the latest."""
    return min(n, n - least_partner(n, percent) + surplus(n, percent))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 4) -> int:
    """An upper bound of the intersection: cut both at a's middle, again and again, and add up the smaller sides."""
    if depth == 0 or len(a) < 2 or len(b) < 2:
        return min(len(a), len(b))
    middle = len(a) // 2
    cut = int(np.searchsorted(b, a[middle]))
    return suffix_bound(a[:middle], b[:cut], depth - 1) + suffix_bound(a[middle:], b[cut:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = least_overlap(len(a), len(b), percent)
    if not need or min(len(a), len(b)) < need or suffix_bound(a, b) < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _row_key() -> Column:
    """A 64-bit hash of id and text; hashing skips nulls, so whether the id is null goes in as well."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def summarise(docs: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: rows of kind 0 with ``doc_id, n, sig, key``, and of kind 1 with slices of a task's counts.

    A task counts hashed shingles of every class once, in a fixed number of counters; slices are compressed.
    """
    width = 1 << SKETCH_BITS
    part = width // SKETCH_SLICES
    names = ["kind", "doc_id", "n", "sig", "slice", "counts", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, id_type = np.zeros(width, np.uint32), set(), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            sigs = [signature(s) for s in sets]
            fresh = []
            for s, sig in zip(sets, sigs, strict=True):
                if len(s) and sig not in seen:
                    seen.add(sig)
                    fresh.append(s)
            if fresh:
                np.add.at(total, np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS), 1)
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int8)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), batch.column(2)], names=names
            )
        if total.any():
            m = SKETCH_SLICES
            blobs = [zlib.compress(np.minimum(total[i * part : (i + 1) * part], 65535).astype("<u2").tobytes(), 1) for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(blobs), pa.nulls(m, pa.int64())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _row_key()).mapInArrow(tidy(run), f"kind byte, doc_id {kind}, n long, sig long, slice int, counts binary, key long")


def count_sketch(passed: DataFrame) -> np.ndarray:
    """Counts of hashed shingles over all documents, 2^SKETCH_BITS of them: slices meet and are added up."""
    width = 1 << SKETCH_BITS
    part = width // SKETCH_SLICES

    def add(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in slices:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(zlib.decompress(raw), "<u2").astype(np.uint64)
        if totals:
            blobs = [zlib.compress(np.minimum(v, 2**32 - 1).astype("<u4").tobytes(), 1) for v in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(blobs)], names=["slice", "counts"])

    merged = passed.where("kind = 1").select("slice", "counts").repartition(SKETCH_SLICES, "slice").mapInArrow(tidy(add), "slice int, counts binary")
    out = np.zeros(width, np.uint32)
    for row in merged.collect():  # all counters, 16 MB before compression whatever the input
        out[row["slice"] * part : (row["slice"] + 1) * part] = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
    return out


def ordered_tokens(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as sorted tokens, rare ones first: the rank of the sketch's count, then 56 bits of the hash."""
    rank = ranks[shingles >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
    return np.sort((rank << np.uint64(56)) | (mix64(shingles) >> np.uint64(8)))


def sketch_ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as ranks of one byte: what stands out of the mean by powers of about 1.2; the bulk shares rank 0."""
    floor = max(2.0, 2.0 * float(counts.mean()))
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts, 1) / floor)), 0, 255).astype(np.uint8)


def hot_spread(counts: np.ndarray) -> np.ndarray:
    """Over how many buckets the classes of a shingle are dealt, by its rank."""
    floor = max(2.0, 2.0 * float(counts.mean()))
    return np.array([max(1, int(floor * 2 ** (r / 4) / HOT_CLASSES)) if r else 1 for r in range(256)], np.uint64)


def prefix_entries(docs: DataFrame, words: int, percent: int, counts: np.ndarray, buckets: int) -> DataFrame:
    """``bucket, entries``: packed prefix entries of every class that a task sees, dealt by token."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch_ranks(counts), hot_spread(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, spread = shared.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            salt = mix64(rows["s"].view(np.uint64)) % spread[rows["t"] >> np.uint64(56)]
            bucket = ((rows["t"] & np.uint64((1 << 40) - 1)) + salt) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            keys, starts = np.unique(bucket, return_index=True)
            blobs = [rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                n = len(s)
                if not n or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                length = prefix_length(n, percent)
                rows = np.empty(length, _ENTRY)
                rows["t"], rows["s"], rows["n"], rows["p"] = ordered_tokens(s, ranks)[:length], sig, n, np.arange(length)
                held.append(rows)
                size += length
                if size >= FLUSH_ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "bucket int, entries binary")


def shared_rows(rows: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's entries those whose shingle several classes have, and how many have it.

    The classes of a hot shingle that was dealt over several buckets never meet here; its count is its rank's, the
    same in all of them and above all others.
    """
    rows = rows[np.lexsort((rows["s"], rows["t"]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["t"][1:] != rows["t"][:-1]) | (rows["s"][1:] != rows["s"][:-1])
    rows = rows[fresh]
    starts = np.flatnonzero(np.concatenate(([True], rows["t"][1:] != rows["t"][:-1]))) if len(rows) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(rows)))
    times = np.repeat(lengths, lengths)
    rank = rows["t"] >> np.uint64(56)
    times = np.where(spread[rank] > 1, (1 << 40) + rank.astype(np.int64), times)
    return rows[times > 1], times[times > 1]


def _meet(blobs: DataFrame, buckets: int, spread: np.ndarray) -> DataFrame:
    """``t, s, n, p, df``: the shared entries of all buckets."""
    shared = blobs.sparkSession.sparkContext.broadcast(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(k, []).append(raw)
        for k in list(held):
            rows, times = shared_rows(np.frombuffer(b"".join(held.pop(k)), _ENTRY), shared.value)
            for lo in range(0, len(rows), 100_000):
                part = rows[lo : lo + 100_000]
                columns = [np.ascontiguousarray(part[c]) for c in ("t", "s", "n", "p")]
                columns[0] = columns[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(times[lo : lo + 100_000])], names=["t", "s", "n", "p", "df"])

    return blobs.repartition(buckets, "bucket").mapInArrow(tidy(run), "t long, s long, n int, p int, df long")


def _rarest(entries: DataFrame, percent: int) -> DataFrame:
    """Of the shared entries those that each class has to keep, with ``score``, the number that it shares.

    The prefixes of two sets that link have o shingles in common, where the smaller one's size gives o at least. So
    the rarest of these is among the first (shared - o + 1) of either, rarest first: a prefix filter on prefixes.
    """
    by = Window.partitionBy("s")
    own = entries.withColumn("score", F.count("*").over(by)).withColumn("at", F.row_number().over(by.orderBy("df", "t")))
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    least = F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * F.ceil(F.lit(percent) * smallest / 100)))
    return own.where(F.col("at") <= F.col("score") - least + 1)


def _first_groups(kept: DataFrame, percent: int) -> DataFrame:
    """``g, s, n, p, score``: members of groups by shingle and size band.

    A band is narrower than the ratio of sizes that a link allows by nothing but rounding, so linked classes are in
    one band or in neighbouring ones: each member goes to its own band's group and to the one below.
    """
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent * (1 + 1e-9)))).cast("int")
    return kept.select(F.explode(F.array(band, band - 1)).alias("b"), "t", "s", "n", "p", "score").select(F.xxhash64("t", "b").alias("g"), "s", "n", "p", "score")


def _pack(kind: int, a, b, n, p, ok) -> pa.RecordBatch:
    m = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, kind, np.int8)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(p, np.int32)), pa.array(np.asarray(ok, bool))],
        names=["kind", "a", "b", "n", "p", "ok"],
    )


def star_member(centre: np.ndarray, own: np.ndarray, smallest: int, percent: int, ranks: np.ndarray) -> tuple[bool, np.ndarray, bool]:
    """(linked, shingles outside the centre that its next groups go by, whether it holds enough of the centre).

    ``smallest`` is the smallest size among the star's members, so no partner asks for less than ``least``.
    """
    n, m = len(own), len(centre)
    inside = centre[np.minimum(np.searchsorted(centre, own), m - 1)] == own
    common = int(inside.sum())
    ok = common >= least_overlap(n, m, percent)
    least = max(least_partner(n, percent), least_overlap(n, smallest, percent))
    outside = ordered_tokens(own[~inside], ranks)
    return ok, outside[: max(0, len(outside) - max(1, least - common) + 1)], common >= least and (not ok or n < m)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Judge pairs (a, b, star, smallest) of classes; computed and stored; ``texts`` is (s, text), one row per class.

    Rows of kind 0 are ``a, b, ok`` for every pair; of kind 1, for members b of a star around a, groups of the next
    round: ``a`` names the group, ``b`` is the member, ``n`` its size and ``p`` the shingle's place among those.
    Each centre's text comes once to every chunk of its members.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b, star, smallest = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            sets = shingle_sets(batch.column(5).to_pylist(), words)
            tested, groups = [], []
            for i, own in enumerate(sets):
                if b[i] is None:
                    centre = (a[i], own)
                    continue
                assert centre is not None and centre[0] == a[i]
                if not star[i]:
                    tested.append((a[i], b[i], linked(centre[1], own, percent)))
                    continue
                ok, tokens, holds = star_member(centre[1], own, smallest[i], percent, shared.value)
                tested.append((a[i], b[i], ok))
                salt = np.uint64(a[i] * _SALT & (1 << 64) - 1)
                names = mix64(np.append(tokens, np.zeros(int(holds), np.uint64)) ^ salt).view(np.int64)
                groups.append((names, np.full(len(names), b[i]), np.full(len(names), len(own)), np.arange(len(names))))
            if tested:
                x, y, ok = zip(*tested, strict=True)
                yield _pack(0, x, y, np.zeros(len(x)), np.zeros(len(x)), ok)
            if any(len(g[0]) for g in groups):
                g, s, n, p = (np.concatenate(c) for c in zip(*groups, strict=True))
                yield _pack(1, g, s, n, p, np.zeros(len(g)))

    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_CHUNK).alias("chunks"))
    dealt = stored(pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b", "star", "smallest"), "dealt")
    none = F.lit(None)
    centres = dealt.select("a", "chunk").distinct().join(texts, F.col("a") == F.col("s")).select("a", "chunk", none.cast("long").alias("b"), F.lit(False).alias("star"), F.lit(0).alias("smallest"), "text")
    members = dealt.join(texts, F.col("b") == F.col("s")).select("a", "chunk", "b", "star", "smallest", "text")
    ordered = centres.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    judged = ordered.mapInArrow(tidy(run), "kind byte, a long, b long, n int, p int, ok boolean")
    with small_batches(pairs.sparkSession, VERIFY_ROWS, VERIFY_BYTES):
        return stored(judged, "tested")


def _round_pairs(members: DataFrame, small: int, percent: int) -> DataFrame:
    """``a, b, star, smallest`` of the groups of ``members`` (g, s, n, p, score, c) that hold two components.

    Small groups give the pairs across components that pass the length and positional filters, others their hub with
    every other member. A pair that both kinds give is the star's.
    """
    hub = F.max(F.struct("score", "s", "n"))
    groups = members.groupBy("g").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), hub.alias("hub"))
    groups = groups.where("c0 <> c1").select("g", "size", "hub")
    here = stored(members.join(groups, "g"), "groups")
    few = here.where(F.col("size") <= small)
    x, y = (few.select("g", *[F.col(k).alias(f"{v}_{k}") for k in ("s", "n", "p", "c")]) for v in "xy")
    need = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / F.lit(100 + percent))
    length = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    # the shared shingle and at most what follows it in the shorter rest can be in common, besides what came before
    bound = F.least("x_p", "y_p") + 1 + F.least(F.col("x_n") - F.col("x_p") - 1, F.col("y_n") - F.col("y_p") - 1)
    position = F.coalesce(bound >= need, F.lit(True))
    expanded = x.join(y, "g").where((F.col("x_s") < F.col("y_s")) & (F.col("x_c") != F.col("y_c")) & length & position)
    expanded = expanded.select(F.col("x_s").alias("a"), F.col("y_s").alias("b"), F.lit(False).alias("star"), F.lit(0).alias("smallest"))
    stars = here.where((F.col("size") > small) & (F.col("s") != F.col("hub.s"))).select(F.col("hub.s").alias("a"), F.col("s").alias("b"), "n")
    least = stars.groupBy("a").agg(F.min("n").alias("smallest"))
    stars = stars.select("a", "b").distinct().join(least, "a").select("a", "b", F.lit(True).alias("star"), "smallest")
    both = expanded.unionByName(stars).groupBy("a", "b").agg(F.max(F.struct("star", "smallest")).alias("m"))
    return both.select("a", "b", "m.*")


def _links(entries: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Verified links (a, b) that connect all that link at all."""
    kept = stored(_first_groups(_rarest(entries, percent), percent), "kept")
    met = kept.groupBy("g").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).where("s0 <> s1").select("g")
    members = kept.join(met, "g", "left_semi").withColumn("c", F.col("s"))
    members = stored(members, "members")
    wanted = stored(classes.join(members.select(F.col("s").alias("sig")).distinct(), "sig").select(F.col("sig").alias("s"), "rep.key"), "wanted")
    near = membership(wanted, "key")(docs.select(_row_key().alias("key"), "text"), "key").where("_member").drop("_member")
    texts = stored(wanted.join(near, "key").select("s", "text").dropDuplicates(["s"]), "candidates")
    scores = members.groupBy("s").agg(F.max("score").alias("score"))
    links, small = None, SMALL_GROUP
    while True:
        pairs = _round_pairs(members, small, percent)
        tested = verify(pairs, texts, words, percent, ranks)
        more = tested.where("kind = 0 and ok").select("a", "b")
        links = more if links is None else links.unionByName(more)
        groups = tested.where("kind = 1")
        if not groups.limit(1).count():
            return links
        known = components(links)
        following = groups.select(F.col("a").alias("g"), F.col("b").alias("s"), "n", F.lit(None).cast("int").alias("p")).distinct().join(scores, "s")
        members = following.join(known.select(F.col("node").alias("s"), "component"), "s", "left")
        members = stored(members.select("g", "s", "n", "p", "score", F.coalesce("component", "s").alias("c")), "members")
        small *= 4


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest doc_id that links reach, the document's own included.

    Two documents link when 100 * intersection >= percent * union of their sets of word shingles. A text with fewer
    words than a shingle is one shingle; null and empty texts have none, link with nothing and are their own
    component. Repeated rows are reported each. Ids may be null or shared by different texts: links are those of the
    texts, and a component without any id has none. Very long texts are one set as any other. An empty table gives no
    rows; extra columns are not read.
    """
    summary, named = _first_rows(docs, words, percent)
    s, c = summary.alias("s"), named.alias("c")
    out = s.join(c, (F.col("s.sig") == F.col("c.sig")) & (F.col("s.n") > 0), "left")
    return out.select("s.doc_id", F.col("s.n").alias("n_shingles"), F.coalesce("c.first.doc_id", "s.doc_id").alias("component_id"))


def _first_rows(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The summary (doc_id, n, sig, key) of every row, and of every class ``sig, first``: its component's row with the
    smallest id, as (no_id, doc_id, key). Rows without an id come last."""
    bounded_batches(docs.sparkSession)
    passed = stored(summarise(docs, words), "sets")
    summary = passed.where("kind = 0").select("doc_id", "n", "sig", "key")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = stored(summary.where("n > 0").groupBy("sig").agg(F.min(row).alias("rep")), "classes")
    buckets = max(1, summary.count() // DOCS_PER_BUCKET)
    counts = count_sketch(passed)
    entries = stored(_meet(prefix_entries(docs, words, percent, counts, buckets), buckets, hot_spread(counts)), "met")
    links = _links(entries, docs, classes, words, percent, sketch_ranks(counts))
    found = components(links)
    named = classes.join(found, classes["sig"] == found["node"], "left").select("sig", F.coalesce("component", "sig").alias("c"), "rep")
    return summary, named.join(named.groupBy("c").agg(F.min("rep").alias("first")), "c").select("sig", "first")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component, all columns: that with the smallest id; of repeated rows with that id and text, one.

    A component without any id keeps a row too. Of texts without shingles one is kept for each id, and every row
    where the id is null, as nothing tells that those are the same document.
    """
    summary, named = _first_rows(docs, words, percent)
    bare = summary.where("n = 0")
    own = bare.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key")).select("key")
    kept = named.select("first.key").distinct().union(own).select("key", F.lit(False).alias("each"))
    kept = kept.union(bare.where("doc_id is null").select("key").distinct().withColumn("each", F.lit(True))).withColumnRenamed("key", "kept")
    rows = docs.select(_row_key().alias("key"), F.struct("*").alias("doc")).join(kept, F.col("key") == F.col("kept"))
    one = rows.where("not each").dropDuplicates(["key"])
    return one.select("doc.*").unionByName(rows.where("each").select("doc.*"))
