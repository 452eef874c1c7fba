"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yieldnorm.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, threshold=30, top=2000):
    f, n = counts(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    out = []
    for (lang, w), a in cand.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        covered = any(la == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                      for (la, v), b in cand.items())
        if not covered:
            out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    final = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        final += [(lang, r, p, a, x, y, m, s) for r, (_, s, a, p, x, y, m) in enumerate(mine, 1)]
    return sorted(final)


def text(seed, words=400):
    r = np.random.default_rng(seed)
    vocab = ["the", "Of", "red", "ship", "é", "ÀB", "sails", "x-y", "漢字", "new", "york", "city"]
    w = [vocab[int(i)] for i in r.zipf(1.3, words) % len(vocab)]
    return "".join(x + [" ", "  ", "\t", " ", " ", ". ", ",", "\n"][int(r.integers(0, 8))] for x in w)


DATA = ([(i, text(i), ["en", "de", None, "", "und"][i % 5]) for i in range(12)]
        + [(20, None, "en"), (21, "", None), (22, " \t.!?\n", "xx"), (23, text(99, 20000), "en")]
        + [(30, "New York City", "fr")] * 40 + [(31, "new york", "fr")] * 5)


def run(spark, rows, **more):
    got = C.top_phrases(spark.createDataFrame(rows, SCHEMA), **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_brute_force(spark):
    got = run(spark, DATA)
    assert got == brute(DATA)
    assert {g[0] for g in got} == {"en", "de", "und", "", "fr"}
    assert ("fr", 1, "new york city", 40, 40, 40, 130, 1_000_000) not in got  # "new york" occurs 45 times
    assert run(spark, DATA, top=3) == brute(DATA, top=3)


def test_small_partitions_tight_summaries_and_several_rounds(spark, monkeypatch):
    for name, value in {"STRETCH": 700, "HELD": 900, "MASS": 4096, "SPARE": 1, "PER_ROUND": 64, "FILTER_BITS": 8}.items():
        monkeypatch.setattr(C, name, value)
    assert run(spark, DATA, threshold=12) == brute(DATA, threshold=12)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == []
    df = spark.createDataFrame(DATA, SCHEMA)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("language", "part", "words", "phrase", "f", "rank", "n")])
    assert sorted(tuple(r) for r in C.top_phrases(more).collect()) == brute(DATA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=8), st.integers(2, 9))
def test_summary_keeps_every_frequent_hash(parts, threshold):
    true, mass = Counter(), 0
    total = C.Summary(0)
    total.capacity = sum(map(len, parts)) // threshold + 1
    for p in parts:
        h, n = np.unique(np.array(p, np.uint64), return_counts=True)
        one = C.Summary(total.capacity)
        one.merge(h, n)
        total.merge(one.hash, one.count, one.taken)
        true.update(p)
        mass += len(p)
    assert total.taken < threshold and len(total.hash) <= total.capacity
    kept = dict(zip(total.hash.tolist(), total.count.tolist()))
    for x, n in true.items():
        assert kept.get(x, 0) <= n <= kept.get(x, 0) + total.taken
        assert n < threshold or x in kept


@pytest.mark.parametrize("values", [[0], [5, 5, 9], [1, 2**47], [2**48 - 1]])
def test_packing_round_trip(values):
    h = np.array(values, np.uint64)
    assert np.array_equal(C.unpacked(C.packed(h)), h)


def test_stretch_words():
    raw = "A b.c  d\ne".encode()
    data, off = np.frombuffer(raw + b"f g", np.uint8), np.array([0, len(raw), len(raw) + 3])
    w = C.Words(data, off, np.array([0, 0]))
    at = w.phrases(2)
    assert w.strings(at, np.full(len(at), 2)).to_pylist() == ["a b", "c d", "f g"]
    assert w.strings(w.phrases(1), np.ones(7, int)).to_pylist() == list("abcdefg")
