"""Hard negatives against all pairs by brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yieldnorm.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=3):
    use = []
    for vid, vec, label in rows:
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        use.append((vid, np.array([int(np.floor(256 * float(np.float32(x)))) for x in vec], object), label))
    last = 1 << 70
    out = []
    for i, (a, va, la) in enumerate(use):
        if a is None or a % every:
            continue
        scores = [(int((va * vb).sum()), b, lb == la) for j, (b, vb, lb) in enumerate(use) if j != i and len(va) == len(vb)]
        order = lambda s: (-s[0], last if s[1] is None else s[1])
        for p, pid, _ in sorted((s for s in scores if s[2]), key=order)[:5]:
            fit = sorted((s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(a, pid, k, n, p, s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def found(spark, rows, every=3, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.mine(df, df["vec_id"] % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) + 1.5 * r.normal(size=(4, d))[r.integers(0, 4, n)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, [float(x) for x in v[i]], int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("rows, anchors", [(8192, 1024), (37, 5)])
def test_equals_brute_force(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(H, "ROWS", rows)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    data = vectors(160, 20, 5)
    assert found(spark, data) == brute(data) != []


def test_nulls_repeats_ties_and_lengths(spark):
    data = vectors(60, 6, 8)
    odd = [(3, None, 1), (6, [0.1, None, 0.2, 0.3, 0.1, 0.1], 1), (9, [float("nan")] * 6, 0), (12, [float("inf")] + [0.0] * 5, 0),
           (15, [0.5] * 6, None), (None, [0.5] * 6, 1), (18, [], 1), (21, [], 2), (24, [0.5, 0.5], 0), (27, [0.4, 0.5], 0),
           (28, [0.2, 0.2], 1), (30, [0.0] * 6, 2)]
    data = data + odd + data[:9] + [(i + 100, v, (l + 1) % 3) for i, v, l in data[:9]]
    assert found(spark, data) == brute(data)


def test_large_components_are_exact(spark):
    data = [(i, [x * 3e6, 2e6], l) for i, (x, l) in enumerate([(1.0, 0), (0.9, 0), (0.7, 1), (0.65, 1), (0.2, 2)])]
    assert found(spark, data, 1) == brute(data, 1) != []


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    data = vectors(40, 4, 2)
    df = spark.createDataFrame(data, SCHEMA)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("row", "id", "v", "window", "lo", "hi", "score", "rank", "asks")])
    assert sorted((tuple(r) for r in H.mine(more, more["vec_id"] % 3 == 0).collect()), key=str) == brute(data)


def test_one_label_gives_nothing_and_a_hot_label_everything(spark):
    data = [(i, v, 0) for i, v, _ in vectors(30, 4, 1)]
    assert found(spark, data) == []
    data = [(i, v, int(i > 55)) for i, v, _ in vectors(60, 4, 1)]
    assert found(spark, data) == brute(data) != []


@pytest.mark.parametrize("least", [0.9, 0.5, 0.1, -1.0])
def test_index_loses_no_pair_and_omits_components(least):
    r = np.random.default_rng(3)
    x, y = (r.normal(size=(n, 40)) * np.geomspace(1, 0.05, 40) for n in (30, 300))
    x, y = (np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)) for v in (x, y))
    t = np.full(30, least * 256 * 256)
    index = H.Index(y, t.min(), np.linalg.norm(x, axis=1).max())
    q, k, s = index.above(x, t)
    full = x @ y.T
    want = np.argwhere(full >= t[:, None])
    assert sorted(zip(q.tolist(), k.tolist())) == [tuple(w) for w in want.tolist()]
    assert np.array_equal(s, full[q, k])
    assert (index.listed[-1] < len(y)) == (least > 0)


def test_relabel_and_matrix(spark):
    flat, off = H.matrix(pa.chunked_array([pa.array([[1], [2, 3]]), pa.array([[4, 5]])]))
    assert flat.tolist() == [1, 2, 3, 4, 5] and off.tolist() == [0, 1, 3, 5]
    data = vectors(50, 4, 6)
    df = spark.createDataFrame(data, SCHEMA)
    got = H.mine(df, df["vec_id"] % 3 == 0, F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 3))
    moved = [(i, v, (l + 1) % 3 if i % 7 == 0 else l) for i, v, l in data]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(moved)
