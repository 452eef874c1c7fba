"""Repeated passages against a plain search of all windows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yieldnorm.llm import repeats as R

SCHEMA = "doc_id long, text string"


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    ids = [1 << 70 if d is None else d for d, _ in rows]
    least = {}
    for b, d in zip(raw, ids):
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for (doc, _), b, d in zip(rows, raw, ids):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    got = R.mark_repeats(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    rows = got.collect()
    for r in rows:
        assert len(r.spans) == r.n_spans and sum(s.stop - s.start for s in r.spans) == r.n_removed
    return sorted((tuple(r)[:5] for r in rows), key=str)


def words(r, n):
    vocab = ["alpha", "béta", "gamma", "漢字", "delta", "of", "a", "-"]
    return " ".join(vocab[i] for i in r.integers(0, len(vocab), n))


def corpus(seed=1, n=40):
    r = np.random.default_rng(seed)
    shared = [words(r, 30), words(r, 60), "x" * 49, "y" * 50, "z" * 300]
    out = []
    for i in range(n):
        parts = [words(r, int(r.integers(0, 40)))] + [shared[k] for k in r.integers(0, 5, int(r.integers(0, 4)))]
        r.shuffle(parts)
        out.append((int(r.integers(0, 10**6)), "".join(parts)))
    return out


def test_equals_brute_force(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 1000


def test_nulls_copies_repeats_and_long_texts(spark):
    r = np.random.default_rng(4)
    one, long = words(r, 40), words(r, 4000)
    rows = [(5, one), (5, one), (5, "q" + one), (9, one), (2, one[:49]), (None, one), (None, one + "!"), (7, None), (None, None), (8, ""),
            (11, long), (12, "." + long), (13, "ab" * 2000), (14, "ba" * 30), (1, "é" * 40), (3, "a" + "é" * 40)]
    rows += [(100 + i, long[:400]) for i in range(20)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("change", [{"HOT": 2, "GROUP_BYTES": 900}, {"STRETCH": 300, "HELD": 40, "MASS": 64}, {"SENT_BYTES": 0}, {"LONG": 400, "STRETCH": 90}])
def test_hot_anchors_small_parts_and_shuffle_joins(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(R, name, value)
    rows = corpus(2) + [(1000 + i, f"{i} {'w' * 55} {i}") for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == brute([(1, None)])
    rows = corpus(3, 15)
    more = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in (
        "key", "doc", "anchor", "anchors", "found", "spans", "sid", "seg", "at", "cut", "n_bytes")])
    assert run(spark, more) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=12), st.integers(1, 5))
def test_collection_order_against_sorting(strings, least):
    off = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    string, start, kind = R.collection_order(np.frombuffer(b"".join(strings), np.uint8).astype(np.int32), off, least)
    tails = [strings[s][a:] for s, a in zip(string, start)]
    assert tails == sorted(tails)
    assert sorted(zip(string.tolist(), start.tolist())) == sorted(
        (i, a) for i, s in enumerate(strings) for a in range(len(s) - least + 1))
    assert [a == b for a, b in zip(kind, kind[1:])] == [a[:least] == b[:least] for a, b in zip(tails, tails[1:])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=130), max_size=6))
def test_segments_hold_each_window_once(texts):
    import pyarrow as pa

    data, off = R.utf8(pa.array(texts, pa.string()))
    start, windows, anchor, row, core = R.anchored(data, off)
    seen = sorted((int(r), int(s - off[r]) + k) for s, w, r in zip(start, windows, row) for k in range(w))
    assert seen == [(i, a) for i, t in enumerate(texts) for a in range(max(0, len(t) - 49))]
    assert (windows <= R.SPAN).all()
    by = {}
    for s, w, h, c in zip(start, windows, anchor, core):
        for k in range(w):
            assert 0 <= c - k <= 26
            assert by.setdefault(data[s + k:s + k + 50].tobytes(), (h, c - k)) == (h, c - k)
