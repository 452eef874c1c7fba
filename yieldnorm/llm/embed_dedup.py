"""Embedding near-duplicates by cross-polytope hashing.

Vectors are scaled to length 1 in double precision and padded to a power of two. A hash applies three rounds of seeded
sign flips and the fast Hadamard transform and takes the signed axis nearest to the result. ``FUNCTIONS`` hashes make a
table's bucket; besides its own bucket a vector enters, for each hash, the bucket that the second nearest axis gives
(multiprobe). Buckets with one vector go. In the others all pairs are verified by cosine >= ``threshold``, by matrix
products over blocks of ``BLOCK`` vectors, spread over tasks; a large bucket takes many blocks. Pairs themselves are
not listed: a block returns each vector's number of links, counting a pair only in the least bucket that both share,
and the links of a spanning forest, from which components are found.

Vectors are compared only when labels are equal and not null and the lengths of the vectors are equal. Null, empty
and zero vectors, and vectors with null or non-finite components, link with nothing. Repeated rows link with each
other like copies. A row's component is the least vec_id (null last) that links reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.functions import arrow_udf

from ..plans.sizing import materialize
from .common import mix64, ship
from .components import components

THRESHOLD, TABLES, FUNCTIONS, SEED = 0.93, 10, 3, 23
#: Vectors of a block, and rows that a task's group holds (about).
BLOCK, GROUP_ROWS = 1024, 20_000
_PAIRS = 100_000


def vectors(lists: pa.Array) -> list:
    """A float64 array for each usable vector, else None."""
    out = []
    for v in lists.to_pylist():
        a = np.array(v, float) if v and None not in v else None
        out.append(a if a is not None and np.isfinite(a).all() and a.any() else None)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row (a power of two wide)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, seed: int = SEED) -> np.ndarray:
    """(rows, tables * (1 + functions)) bucket numbers of unit vectors: own buckets and probes of each table."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng((seed, dim))
    out = []
    for t in range(tables):
        best, second = [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            a, b = order[:, 0], order[:, 1]
            for axis, into in ((a, best), (b, second)):
                into.append((2 * axis + (y[np.arange(n), axis] > 0)).astype(np.uint64))
        for probe in range(-1, functions):
            key = np.full(n, np.uint64(t * 1_000_003 + dim), np.uint64)
            for f in range(functions):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + (second if f == probe else best)[f])
            out.append(key)
    return np.stack(out, 1)


@arrow_udf(ArrayType(LongType()))
def bucket_lists(lists: pa.Array, labels: pa.Array) -> pa.Array:
    """Bucket numbers of each vector, its label's among them; null where it links with nothing."""
    made = vectors(lists)
    label = labels.to_pylist()
    out = [None] * len(made)
    for dim in {len(v) for v in made if v is not None}:
        rows = [i for i, v in enumerate(made) if v is not None and len(v) == dim and label[i] is not None]
        for i in range(0, len(rows), 4096):
            part = rows[i:i + 4096]
            keys = buckets(unit(np.stack([made[r] for r in part])))
            of = mix64(np.array([label[r] for r in part], np.int64).view(np.uint64))
            for r, k in zip(part, mix64(keys ^ of[:, None]).view(np.int64)):
                out[r] = np.unique(k)
    return pa.array(out, pa.list_(pa.int64()))


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold: within x (i < j), or between x and y."""
    i, j = np.nonzero((x @ (x if y is None else y).T) >= threshold - 1e-9)
    if y is None:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), _PAIRS):  # the deciding sums are made alike for every pair
        s = slice(k, k + _PAIRS)
        keep[s] = np.einsum("nd,nd->n", x[i[s]], (x if y is None else y)[j[s]]) >= threshold
    return i[keep], j[keep]


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number that both rows of two lists of bucket numbers hold."""
    least = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        hit = (b == a[:, k:k + 1]).any(1)
        least = np.where(hit, np.minimum(least, a[:, k]), least)
    return least


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n by the links."""
    of = np.arange(n)
    while True:
        low = of.copy()
        np.minimum.at(low, i, of[j])
        np.minimum.at(low, j, of[i])
        low = low[low]
        if (low == of).all():
            return of
        of = low


def compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links of the blocks in a group: rows (a, b, n): n links of a counted, and a link a-b for components (b may be a)."""
    bucket, lo, hi, mine, row = (group[c].to_numpy() for c in ("bucket", "lo", "hi", "block", "row"))
    lists = group["keys"].to_pylist()
    width = max(map(len, lists))
    keys = np.array([k + [k[0]] * (width - len(k)) for k in lists], np.int64)
    vecs = [np.array(v, float) for v in group["vec"].to_pylist()]
    order = np.lexsort((row, mine, hi, lo, bucket))
    cell = np.stack([bucket, lo, hi])[:, order]
    ends = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(0), [True])))
    a_out, b_out, n_out = [], [], []
    for s, e in zip(ends, ends[1:]):
        at = order[s:e]
        one, two = at[mine[at] == lo[at]], at[mine[at] == hi[at]]
        if lo[at[0]] == hi[at[0]]:
            x = unit(np.stack([vecs[r] for r in one]))
            i, j = linked(x, None, threshold)
            i, j, every = one[i], one[j], one
        elif len(one) and len(two):
            i, j = linked(unit(np.stack([vecs[r] for r in one])), unit(np.stack([vecs[r] for r in two])), threshold)
            i, j, every = one[i], two[j], np.concatenate((one, two))
        else:
            continue
        if not len(i):
            continue
        count = np.zeros(len(row), np.int64)
        for k in range(0, len(i), _PAIRS):
            p, q = i[k:k + _PAIRS], j[k:k + _PAIRS]
            here = first_shared(keys[p], keys[q]) == bucket[at[0]]
            np.add.at(count, p[here], 1)
            np.add.at(count, q[here], 1)
        place = np.full(len(row), -1)
        place[every] = np.arange(len(every))
        root = every[forest(place[i], place[j], len(every))]
        some = (count[every] > 0) | (root != every)
        a_out.append(row[every[some]])
        b_out.append(row[root[some]])
        n_out.append(count[every[some]])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"a": cat(a_out), "b": cat(b_out), "n": cat(n_out)})


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, vec: str = "embedding", key: str = "vec_id",
                    label: str = "label") -> DataFrame:
    """A row per row of ``table``: vec_id, n_links, component_id, kept (vec_id is the component's)."""
    ship(table.sparkSession)
    rows = table.select(table[key].alias("vec_id"), table[vec].cast("array<double>").alias("vec"),
                        F.xxhash64(table[label].cast("string")).alias("h"), table[label].isNull().alias("z"))
    rows = rows.select("vec_id", "vec", F.when(~F.col("z"), F.col("h")).alias("label"))
    rows = materialize(rows.withColumn("keys", bucket_lists("vec", "label")).drop("label")
                       .withColumn("row", F.monotonically_increasing_id()), "vectors")
    entries = rows.select("row", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = entries.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # a block meets every block of its bucket, itself among them
    entries = materialize(
        entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("row", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "entries")
    groups = max(1, -(-entries.count() // GROUP_ROWS))
    dealt = entries.join(rows.select("row", "vec", "keys"), "row")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(groups)))
    found = dealt.groupBy("g").applyInArrow(lambda t: compare(t, threshold), "a long, b long, n long")
    found = materialize(found, "found")
    degree = found.groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    placed = components(found.select("a", "b")).withColumnRenamed("node", "row")
    out = rows.select("vec_id", "row").join(degree, "row", "left").join(placed, "row", "left")
    out = materialize(out.withColumn("component", F.coalesce("component", "row")), "placed")
    # written, so that the join can split a component that holds many rows
    least = materialize(out.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    out = out.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                              "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
