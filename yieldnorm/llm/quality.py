"""Quality classifier: Bradley-Terry pairwise ranking.

Each text becomes a vector of counts and shares (bytes, words, repetition). From labelled documents, preference pairs
(a good one before a bad one) are drawn; the weights minimise the logistic loss of the feature differences. A
document's strength is weights . features. The threshold is the quantile of training strengths that parts the classes
best; strengths are mapped to 0..1 so that the threshold falls on ``CUT``.

At most ``MAX_FIT`` labelled rows, the first by a hash, and ``PAIRS`` pairs are used for the fit; both are parameters.
Null and empty texts have an all-zero vector but for a flag, and a score like others. Repeated label rows of a document count once (the
least label); null labels don't count. Without labels of both classes all scores are 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, DoubleType

from ..plans.sizing import materialize
from .common import give_back, mix64, remainder, ship, slices, text_or_empty, utf8, word_bounds, word_hashes

MAX_FIT, PAIRS, CUT, FOLDS, SEED = 20_000, 40_000, 0.3, 5, 11

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A float32 vector for each text; see the names in the code."""
    data, off = utf8(texts)
    return np.vstack([_features(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices(off)]
                     or [np.zeros((0, WIDTH), np.float32)])


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent value's count for each row."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    o = np.lexsort((h, row))
    r, x = row[o], h[o]
    head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))))
    n = np.diff(np.append(head, len(x)))
    top = np.zeros(rows)
    np.maximum.at(top, r[head], n)
    return np.bincount(r[head], minlength=rows).astype(float), top


def _features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows, size = len(off) - 1, np.diff(off).astype(float)
    of = np.repeat(np.arange(rows), np.diff(off))
    hist = np.bincount(of * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float)
    n = np.maximum(size, 1)[:, None]
    ascii_share = np.sqrt(hist[:, 32:127] / n)  # each printable byte
    groups = np.stack([hist[:, _LETTER].sum(1), hist[:, 65:91].sum(1), hist[:, 48:58].sum(1), hist[:, 128:].sum(1),
                       hist[:, 10], hist[:, 9]], 1) / n
    start, end, row = word_bounds(data, off)
    h = word_hashes(data, start, end)
    words = np.bincount(row, minlength=rows).astype(float)
    w = np.maximum(words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, rows) / w
    spread = np.sqrt(np.maximum(np.bincount(row, length ** 2, rows) / w - mean ** 2, 0))
    long = np.bincount(row, length > 20, rows) / w
    kinds, top = _distinct(row, h, rows)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1]))) if len(h) else np.zeros(0)
    pair = mix64(h[1:] ^ (h[:-1] << np.uint64(1))) if len(h) > 1 else np.zeros(0, np.uint64)
    inner = row[1:] == row[:-1] if len(h) > 1 else np.zeros(0, bool)
    pairs, _ = _distinct(row[1:][inner] if len(h) > 1 else row[:0], pair[inner], rows)
    last = data[end - 1] if len(h) else data[:0]
    tail = np.bincount(row, ~_LETTER[last] & ~((last >= 48) & (last <= 57)), rows) / w
    empty = (words == 0).astype(float)
    rest = np.stack([np.log1p(size), np.log1p(words), mean, spread, long, kinds / w, np.log1p(top) / np.log1p(w + 1),
                     top / w, np.bincount(row, same, rows) / w, pairs / np.maximum(words - 1, 1), tail, empty], 1)
    rest[words == 0, :-1] = 0
    return np.hstack([ascii_share, groups, rest]).astype(np.float32)


WIDTH = 95 + 6 + 12


@arrow_udf(BinaryType())
def vectors(texts: pa.Array) -> pa.Array:
    return pa.array([v.tobytes() for v in features(texts)], pa.binary())


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = SEED) -> np.ndarray:
    """Bradley-Terry weights: logistic loss of x[good] - x[bad] over drawn pairs, by Newton steps."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    for _ in range(12):
        grad, curve = ridge * w, ridge * np.eye(len(w))
        for i in range(0, pairs, 10_000):
            d = x[a[i:i + 10_000]] - x[b[i:i + 10_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the bad one wins
            grad -= d.T @ p / pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def best_quantile(strength: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the strengths at which a cut has the best mean of both classes' hit rates."""
    o = np.argsort(strength, kind="stable")
    bad_below = np.concatenate(([0], np.cumsum(y[o] == 0)))
    good_above = (y == 1).sum() - np.concatenate(([0], np.cumsum(y[o] == 1)))
    right = bad_below / max(1, (y == 0).sum()) + good_above / max(1, (y == 1).sum())
    top = np.flatnonzero(right >= right.max() - 1e-12)
    return float(top[len(top) // 2]) / len(y)


def scorer(x: np.ndarray, y: np.ndarray, cut: float = CUT, seed: int = SEED):
    """Weights, offset: the score is the logistic function of weights . features + offset."""
    if not len(y) or (y == 1).all() or (y == 0).all():
        return np.zeros(WIDTH), 0.0
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = fit_pairs((x - mean) / scale, y, seed=seed) / scale
    strength = x @ w
    q = best_quantile(strength, y)
    s = np.sort(strength)
    k = min(max(int(round(q * len(s))), 1), len(s) - 1)
    return w, float(np.log(cut / (1 - cut)) - (s[k - 1] + s[k]) / 2)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        cut: float = CUT, max_fit: int = MAX_FIT):
    """A function column that scores texts, from the labels of the learning folds. The labelled rows used, at most
    ``max_fit``, are broadcast to the documents; their vectors come to the driver."""
    ship(docs.sparkSession)
    known = labels.select(labels[key].alias("doc_id"), labels[label].cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter(remainder(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit), "labels")
    base = docs.select(docs[key].alias("doc_id"), text_or_empty(docs, text).alias("text"))
    rows = base.join(F.broadcast(known), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), vectors("text").alias("x"))
    # of rows that share an id, the text with the least hash is learned
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("one")).select("doc_id", "one.x", "one.y").orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), WIDTH).astype(float)
    w, offset = scorer(x, np.array([r.y for r in rows], int), cut)

    @arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(1 / (1 + np.exp(-np.clip(features(texts).astype(float) @ w + offset, -500, 500))))
        give_back()
        return out

    return score


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
             cut: float = CUT, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of doc_id modulo FOLDS is 0; such labels aren't learned),
    score, predicted."""
    score = fit(docs, labels, text, key, label, cut, max_fit)
    out = docs.select(docs[key].alias("doc_id"), (remainder(docs[key], FOLDS) == 0).alias("held_out"),
                      score(text_or_empty(docs, text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
             cut: float = CUT, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, with all their columns."""
    return docs.filter(fit(docs, labels, text, key, label, cut, max_fit)(text_or_empty(docs, text)) >= cut)
