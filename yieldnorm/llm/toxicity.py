"""Toxicity by class-conditional Kneser-Ney models.

For each class, the labelled documents that hold a word (a run of letters, digits and bytes above ASCII of the
lower-cased text) are counted; a word that a document repeats counts once. A class gives a word its absolutely
discounted share, and the mass that discounting frees goes to a backoff shared by both classes: Kneser-Ney's
continuation counts, the number of different words that a word follows. So rare words, which one class happens to
hold, say little. A document's evidence is the difference of its words' two log-likelihoods, normalised by length: over
the whole text and over its most toxic window of ``WINDOW`` words, for all words and for those beyond ``TAILS``. A
logistic function of these, fitted on labelled documents that are each scored by the counts of the other half of
them, gives the score.

Counts cover all labelled rows and grow with them: a distributed table has a row for each word (by its 63-bit hash),
with its documents by class and half and the number of different words before it (or the text's beginning), counted
from the distinct pairs. Evidence is computed in that table. Words in most documents are broadcast, as far as
``MODEL_BYTES`` go; a document's other words meet the table in a shuffle join. At most ``MAX_FIT`` rows are used for
the weights. Null and empty texts have no evidence and the score of that. Repeated label rows of a document count once
(the largest label); null labels don't count. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..plans.sizing import broadcast_if_small, materialize
from .common import remainder, ship, slices, utf8, word_hashes

#: A word's key is its 64-bit hash modulo BUCKETS, which a signed long holds.
BUCKETS, WINDOW, DISCOUNT, FOLDS, HELD, CUT, MAX_FIT = 1 << 63, 32, 2.0, 3, 1, 0.7, 50_000
TAILS = (1.0, 2.0)
#: Labels are broadcast to the documents up to this size, else the join shuffles.
LABEL_BYTES = 64 << 20
#: Bytes of the words that are broadcast (a key and three values of evidence each).
MODEL_BYTES, WORD_BYTES = 32 << 20, 20
#: Pairs that a counting task holds before it sums and sends them.
HELD_PAIRS = 1 << 20
#: Words in this many documents or more are broadcast or joined together.
MANY = 10_000
COUNTS = ("n00", "n01", "n10", "n11")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside, cut = _WORD[data], np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(inside & np.concatenate(([True], cut[1:-1] | ~inside[:-1])))
    end = np.flatnonzero(inside & np.concatenate((cut[1:-1] | ~inside[1:], [True]))) + 1
    return word_hashes(data, start, end), np.searchsorted(off, start, "right") - 1


def lowered(texts: pa.Array):
    """(rows from, rows to, hashes, row of each) over slices of the lower-cased texts."""
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    for i, j in slices(off):
        h, row = words(data[off[i]:off[j]], off[i:j + 1] - off[i])
        yield i, j, h, row


def keys(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def count_words(labelled: DataFrame) -> DataFrame:
    """bucket (a word's key), n00, n01, n10, n11 (documents by class and half), seen (number of different words before
    it, the text's beginning among them) from rows (text, toxic, half). A task sums its rows before the shuffle; a
    word's counts travel with one of its pairs."""
    names = ["bucket", "before", *COUNTS]

    def pairs(h, row, kind):
        """The distinct pairs of some rows, with the counts of each word at its first."""
        u, at = np.unique(keys(h), return_inverse=True)
        once = np.unique(row * len(u) + at)
        n = np.bincount(kind[once // len(u)] * len(u) + once % len(u), minlength=4 * len(u)).reshape(4, len(u))
        before = np.concatenate(([0], at[:-1] + 1))
        before[np.concatenate(([True], row[1:] != row[:-1]))] = 0
        both = np.unique(at * (len(u) + 1) + before)
        w = both // (len(u) + 1)
        at_first = np.zeros((4, len(both)), np.int64)
        at_first[:, np.flatnonzero(np.diff(w, prepend=-1))] = n
        before = np.concatenate(([-1], u))[both % (len(u) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u[w], before, *at_first)], names=names)

    def summed(held):
        t = pa.Table.from_batches(held).group_by(names[:2], use_threads=False).aggregate([(c, "sum") for c in COUNTS])
        t = t.select([*names[:2], *[f"{c}_sum" for c in COUNTS]]).rename_columns(names)
        return t.combine_chunks().to_batches(max_chunksize=100_000)

    def count(batches):
        held = []
        for b in batches:
            kind = (b.column(1).to_numpy(zero_copy_only=False) * 2 + b.column(2).to_numpy(zero_copy_only=False)).astype(int)
            for i, j, h, row in lowered(b.column(0)):
                if len(h):
                    held.append(pairs(h, row, kind[i:j]))
                if sum(x.num_rows for x in held) >= HELD_PAIRS:
                    yield from summed(held)
                    held = []
        if held:
            yield from summed(held)

    made = labelled.mapInArrow(count, "bucket long, before long, n00 long, n01 long, n10 long, n11 long")
    made = made.groupBy("bucket", "before").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return made.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("seen"))


def continuation(seen: np.ndarray, places: int | None = None, kinds: float | None = None) -> np.ndarray:
    """Share of each word in all (predecessor, word) kinds. If ``seen`` is a part, the whole has ``places`` words (one
    of them for those never seen) and ``kinds`` kinds."""
    places, kinds = places or len(seen), float(seen.sum()) if kinds is None else kinds
    return (seen + 1.0 / places) / (kinds + 1.0)


def class_log(n: np.ndarray, shared: np.ndarray, discount: float = DISCOUNT, sums: tuple | None = None) -> np.ndarray:
    """Log-probability of each word under one class. ``sums``: the counts of the class, and what discounting frees of
    them, if ``n`` is a part."""
    count, freed = sums or (n.sum(), np.minimum(n, discount).sum())
    total = max(1.0, float(count))
    free = float(freed) / total if count else 1.0
    return np.log(np.maximum(n - discount, 0) / total + free * shared)


#: Counts of the toxic and of the ordinary class in half 0, in half 1 and in both.
SIDES = [(("n10",), ("n00",)), (("n11",), ("n01",)), (("n10", "n11"), ("n00", "n01"))]


def sums_of(counted: DataFrame) -> dict:
    """Words and kinds of all, and the sums that ``class_log`` needs of each side."""
    aggs = [F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("seen"), F.lit(0)).alias("kinds")]
    for side in (x for both in SIDES for x in both):
        n = sum((F.col(c) for c in side), F.lit(0))
        aggs += [F.coalesce(F.sum(n), F.lit(0)).alias("+".join(side)),
                 F.coalesce(F.sum(F.least(n.cast("double"), F.lit(DISCOUNT))), F.lit(0.0)).alias("free " + "+".join(side))]
    return counted.agg(*aggs).first().asDict()


def evidence(n: np.ndarray, seen: np.ndarray, sums: dict) -> np.ndarray:
    """Rows: log(P toxic / P ordinary) of each word from half 0, half 1 and all labelled documents. ``n``: rows as in
    COUNTS."""
    shared = continuation(seen, sums["words"] + 1, sums["kinds"])
    side = lambda cs: class_log(sum(n[COUNTS.index(c)] for c in cs), shared,
                                sums=(sums["+".join(cs)], sums["free " + "+".join(cs)]))
    return np.stack([side(t) - side(o) for t, o in SIDES]).astype(np.float32)


def weigh(counted: DataFrame, sums: dict) -> DataFrame:
    """bucket, docs (documents that hold the word), e (its three values of evidence)."""
    @arrow_udf(ArrayType(FloatType()))
    def of(n00: pa.Array, n01: pa.Array, n10: pa.Array, n11: pa.Array, seen: pa.Array) -> pa.Array:
        n = np.stack([x.to_numpy(zero_copy_only=False) for x in (n00, n01, n10, n11)])
        e = evidence(n, seen.to_numpy(zero_copy_only=False), sums).T
        return pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, 3), pa.int32()), pa.array(e.ravel()))

    return counted.select("bucket", F.expr(" + ".join(COUNTS)).alias("docs"), of(*COUNTS, "seen").alias("e"))


def common_from(weighed: DataFrame, max_bytes: int) -> int:
    """The least number of documents for which all words in so many or more fit ``max_bytes``; above MANY: none do."""
    bins = weighed.groupBy(F.least("docs", F.lit(MANY)).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, least = max_bytes // WORD_BYTES, MANY + 1
    for r in sorted(bins, key=lambda r: -r.d):
        room -= r.n
        if room < 0:
            break
        least = r.d
    return least


def find(key: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each key among rising ones, the number of these if it isn't there."""
    if not len(among):
        return np.zeros(len(key), np.int64)
    at = np.searchsorted(among, key)
    return np.where(among[np.minimum(at, len(among) - 1)] == key, at, len(among))


def rare_words(base: DataFrame, rest: DataFrame, table) -> DataFrame:
    """k1, k2 (hashes of a text), buckets, es (words of the text that ``table`` lacks and ``rest`` has, with their
    evidence). Texts without such words have no row."""
    def words_of(batches):
        for b in batches:
            k1, k2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for i, j, h, row in lowered(b.column(0)):
                u, at = np.unique(keys(h), return_inverse=True)
                rare = find(u, table.value[0]) == len(table.value[0])
                once = np.unique((row * len(u) + at)[rare[at]]) if len(u) else np.zeros(0, np.int64)
                row = i + once // max(1, len(u))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], u[once % max(1, len(u))])],
                                                 names=["k1", "k2", "bucket"])

    held = base.select("text", *text_keys()).mapInArrow(words_of, "k1 long, k2 long, bucket long").distinct()
    met = held.join(rest, "bucket").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("bucket", "e"))).alias("w"))
    return met.select("k1", "k2", F.col("w.bucket").alias("buckets"), F.flatten("w.e").alias("es"))


def text_keys() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def normalised(e: np.ndarray, row: np.ndarray, rows: int, window: int = WINDOW) -> np.ndarray:
    """For each row: the mean evidence of its words, and of its best ``window`` words running (of all, if it has fewer,
    over ``window``). ``row`` rises."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros((rows, 2))
    if not len(e):
        return out
    out[:, 0] = np.bincount(row, e, rows) / np.maximum(n, 1)
    sums = np.concatenate(([0.0], np.cumsum(e, dtype=float)))
    last = np.cumsum(n)
    at = np.arange(len(e))
    hi = np.minimum(at + window, last[row])
    lo = np.maximum(hi - window, (last - n)[row])
    full = np.flatnonzero(n)
    out[full, 1] = np.maximum.reduceat((sums[hi] - sums[lo]) / window, (last - n)[full])
    return out


def measures(e: np.ndarray, row: np.ndarray, rows: int, window: int = WINDOW) -> np.ndarray:
    """The values that the score is made of: normalised evidence, its parts beyond TAILS, and the strongest word's."""
    top = np.zeros((rows, 1))
    if len(e):
        n = np.bincount(row, minlength=rows)
        full = np.flatnonzero(n)
        top[full, 0] = np.maximum.reduceat(e, (np.cumsum(n) - n)[full])
    return np.hstack([normalised(e, row, rows, window), top,
                      *[normalised(np.maximum(e - t, 0), row, rows, window) for t in TAILS]])


N_MEASURES = 3 + 2 * len(TAILS)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the offset) by Newton steps; classes weigh as they are."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
             cut: float = CUT, max_fit: int = MAX_FIT, max_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of doc_id modulo FOLDS is HELD; such labels aren't learned),
    score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    known = labels.select(labels[key].alias("doc_id"), labels[label].cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter(~held).groupBy("doc_id").agg(F.max("y").alias("y"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    known = materialize(known.withColumn("half", half), "labels")
    small, _ = broadcast_if_small(known, row_bytes=16, max_bytes=LABEL_BYTES)
    counted = materialize(count_words(base.join(small, "doc_id").select("text", "y", "half")), "counted")
    sums = sums_of(counted)
    weighed = materialize(weigh(counted, sums), "weighed")
    least = common_from(weighed, max_bytes)
    got = weighed.filter(F.col("docs") >= least).select("bucket", "e").toArrow()
    order = np.argsort(common := got["bucket"].to_numpy())
    e = got["e"].combine_chunks().flatten().to_numpy().reshape(-1, 3)[order]
    never = evidence(np.zeros((len(COUNTS), 1)), np.zeros(1), sums).T
    table = spark.sparkContext.broadcast((common[order], np.vstack([e, never])))  # the last for words that aren't there

    @arrow_udf(ArrayType(DoubleType()))
    def look(texts: pa.Array, half: pa.Array, buckets: pa.Array, es: pa.Array) -> pa.Array:
        half, out = half.to_numpy(zero_copy_only=False), [np.zeros((0, 2 * N_MEASURES))]
        for i, j, h, row in lowered(texts):
            u, at = np.unique(keys(h), return_inverse=True)
            mine = table.value[1][find(u, table.value[0])][at]
            own = buckets[i:j].fill_null([])
            if len(rare := own.flatten()):  # each row has its own, in order: a word stands in all rows that hold it
                uniq, first = np.unique(rare.to_numpy(), return_index=True)
                f = find(u, uniq)
                values = np.vstack([es[i:j].fill_null([]).flatten().to_numpy().reshape(-1, 3)[first], np.zeros((1, 3))])
                mine = np.where((f < len(uniq))[at][:, None], values[f][at], mine)
            other = np.where(half[i:j][row] == 0, mine[:, 1], mine[:, 0])
            out.append(np.hstack([measures(mine[:, 2], row, j - i), measures(other, row, j - i)]))
        flat = np.vstack(out)
        ends = np.arange(0, flat.size + 1, 2 * N_MEASURES)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel()))

    if len(common) < sums["words"]:
        rare = materialize(rare_words(base, weighed.filter(F.col("docs") < least).select("bucket", "e"), table), "rare")
        base = base.select("*", *text_keys()).join(rare, ["k1", "k2"], "left")
    else:
        none = F.lit(None)
        base = base.select("*", none.cast("array<long>").alias("buckets"), none.cast("array<float>").alias("es"))
    made = materialize(base.select("doc_id", look("text", half, "buckets", "es").alias("x")), "evidence")
    rows = made.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).select("x", "y").collect()
    y = np.array([r.y for r in rows], int)
    if len(y) and 0 < y.sum() < len(y):
        w = logistic(np.array([r.x[N_MEASURES:] for r in rows]), y)  # by the counts of the other half
        logit = sum((F.col("x")[k] * float(w[k]) for k in range(N_MEASURES)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), logit))))
    else:
        score = F.lit(0.0)
    out = made.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
