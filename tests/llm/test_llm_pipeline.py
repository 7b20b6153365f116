"""The pipeline: columns, decisions, and agreement with its operators."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

import corpus_pipeline
from fluvigrid.llm._common import stored, table
from fluvigrid.llm.catalogue import tokenizer_path

from test_llm_operators import brute_bayes, brute_components, edit_best, prose


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[4] and last.where("n_tokens < 1").count() == 0


def test_run_is_the_stages(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert docs.count() == 0


def brute_pipeline(docs, items):
    """The five stages in plain Python over (doc_id, text, lang, source) rows: (doc_id, start, n_tokens, ids_crc32)."""
    from tokenizers import Tokenizer

    fit = [(t, lang) for i, t, lang, _ in docs if lang is not None and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 5]
    judged = brute_bayes(fit, [d[1] for d in docs])
    docs = [d for d, (lang, score) in zip(docs, judged, strict=True) if lang != "und" and score >= 0.5]

    groups = collections.defaultdict(list)
    for d, (_, part) in zip(docs, brute_components([d[1] for d in docs], 5, 80), strict=True):
        groups[part].append(d)
    docs = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]

    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [n for t in items if t and (n := plain(t))]
    held = lambda t, n: edit_best(n, t) <= int(0.07 * len(n)) if len(n) >= 40 else f" {n} " in f" {t} "
    docs = [d for d in docs if not any(held(plain(d[1]), n) for n in items)]

    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1]))
    own = collections.defaultdict(list)
    for d in docs:
        own[d[3]].append(d)
    sizes = {s: sum(map(size, g)) for s, g in own.items()}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    targets, free = {}, set(own)
    while free:
        level = (1.5 * sum(sizes.values()) - sum(targets.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in free}
        free = free - over if over else set()
    mixed = []
    for s, g in own.items():
        epochs, before = math.floor(targets[s]) // sizes[s], 0
        left = math.floor(targets[s]) - epochs * sizes[s]
        for d in sorted(g, key=lambda d: (hashlib.md5(f"mix:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0, size(d))):
            taken = epochs * size(d) + max(0, min(size(d), left - before))
            mixed += [d] * math.floor(taken / size(d) + 0.5)
            before += size(d)

    tk, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for i, t, _, _ in sorted(mixed, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    vocabulary = {"en": "the and of to was is that with rain river water stone", "de": "der die und nicht ein war mit regen fluss wasser stein", "fr": "le la et ne pas une avec pluie fleuve eau pierre"}
    rng = np.random.default_rng(4)
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang].split(), n)) + f" {prose(n, int(rng.integers(1 << 30)))}"
    item, rows = prose(30, 77), []
    for k in range(45):
        lang = sorted(vocabulary)[k % 3]
        rows.append((k, text(lang, 25 + k), lang if k % 4 else None, [None, "a", "b", "c", "b"][k % 5]))
    rows += [(100, rows[3][1], "en", "a"), (101, rows[4][1] + " end", None, "a"), (102, None, "en", "a"), (103, "", "de", "b"), (104, "12 !?", "fr", "b")]
    rows += [(105, rows[5][1] + " " + item + " x", "fr", "c"), (106, rows[6][1] + " Two. Words", "en", None), (6, rows[6][1], None, "a"), (None, text("de", 30), "de", "c"), (107, text("en", 4_000), "en", "c")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), 7) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, rounds int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [item.upper(), "two words", None, ""]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == brute_pipeline(rows, items) and len(got) > 40
