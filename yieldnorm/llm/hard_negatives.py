"""Hard negatives by threshold joins in the manner of L2AP.

A row's vector is taken as integers, floor(256 * x); a score is an inner product of two such vectors. Anchors meet all
rows in cells of a grid (a block of anchors, a block of rows, both dealt by hash), so no cell grows with a label, and a
cell returns at most ``want`` rows for each window. A window is a range of scores for one anchor; its first rows by
score are sought with a threshold that starts near the top of the window and is lowered until the window is full or its
lower end is reached.

A threshold join works on an inverted index of the cell's rows: components are ordered by energy and dealt to stripes;
a row's last stripes, as long as their norm times the largest anchor's norm stays below the threshold, are left out of
the index. Partial scores are accumulated stripe by stripe; a pair is dropped as soon as its partial score plus the
product of what is left of both norms can't reach the threshold. What remains is completed with the omitted stripes, so
all scores are exact.

Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of other length than the
anchor's never meet it. A null id belongs to no anchor and comes last among ties. Repeated rows are rows of their own:
a copy of an anchor is one of its positives. Ties of score and id are equal rows. An empty table, or one without
anchors, gives no rows. Other columns of the input are ignored, whatever their names. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import materialize
from .common import ship

#: Rows and anchors of a cell, components of a stripe, and anchors that meet a block at once.
ROWS, ANCHORS, STRIPE, AT_ONCE = 8192, 1024, 8, 64
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A window's limits in percent of the positive's score, and the steps in which its threshold is lowered.
LOW, HIGH, LEVELS = 30, 90, 4
_EXACT = 1 << 53
_LAST = np.iinfo(np.int64).max


class Index:
    """Inverted index of ``rows`` (n x d) for inner products of at least ``least`` with queries of norm ``norm`` or less."""

    def __init__(self, rows: np.ndarray, least: float, norm: float):
        n, d = rows.shape
        self.dims = np.argsort(-np.square(rows.astype(float)).sum(0), kind="stable")
        self.cuts = list(range(0, d, STRIPE)) + [d]
        y = rows[:, self.dims]
        self.left = remaining(y, self.cuts)
        # stripes of a row that stay in the index; rows with more of them come first, so each stripe lists a prefix
        kept = (self.left[:, :-1] * norm * (1 + 1e-9) >= least).sum(1) if least > 0 else np.full(n, len(self.cuts) - 1)
        self.order = np.argsort(-kept, kind="stable")
        self.rows, self.left, self.kept = y[self.order], self.left[self.order], kept[self.order]
        self.listed = [int(np.searchsorted(-self.kept, -c, "left")) for c in range(len(self.cuts) - 1)]

    def above(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, row, score) with a score of at least the query's ``least``."""
        x = queries[:, self.dims]
        left = remaining(x, self.cuts)
        alive = np.arange(len(self.rows))
        part = np.zeros((len(x), len(alive)), self.rows.dtype)
        ok = np.ones(part.shape, bool)
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            m = int(np.searchsorted(alive, self.listed[s]))
            part[:, :m] += x[:, a:b] @ self.rows[alive[:m], a:b].T
            lacks = np.minimum(s + 1, self.kept[alive])  # the first stripe that a row's partial score lacks
            ok &= part + left[:, lacks] * self.left[alive, lacks] * (1 + 1e-9) + 1 >= least[:, None]
            some = ok.any(0)
            if some.mean() < 0.5:
                alive, part, ok = alive[some], part[:, some], ok[:, some]
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):  # what the index omits
            m = int(np.searchsorted(alive, self.listed[s]))
            if m < len(alive):
                part[:, m:] += x[:, a:b] @ self.rows[alive[m:], a:b].T
        q, r = np.nonzero(ok & (part >= least[:, None]))
        return q, self.order[alive[r]], part[q, r]


def remaining(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of each row's components from each cut on."""
    squares = np.square(x.astype(float))
    return np.sqrt(np.stack([squares[:, c:].sum(1) for c in cuts], 1)) if x.shape[1] else np.zeros((len(x), len(cuts)))


def fill_windows(queries: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, key: np.ndarray,
                 allowed: np.ndarray, want: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window, rows, scores) of the first ``want`` allowed rows of each window by score, then ``key``; a window is a
    range lo..hi for the query ``owner``."""
    out = []
    if not len(rows) or not len(owner):
        return out
    reach = np.sqrt(np.square(queries.astype(float)).sum(1)) * np.sqrt(np.square(rows.astype(float)).sum(1).max()) + 1
    top = np.minimum(hi.astype(float), reach[owner])
    end = np.maximum(lo.astype(float), -reach[owner])
    norm = np.sqrt(np.square(queries.astype(float)).sum(1))
    todo = np.flatnonzero(top >= end)
    for level in range(1, LEVELS + 1):
        if not len(todo):
            break
        threshold = end + (top - end) * (1 - level / LEVELS)
        least = np.full(len(queries), np.inf)
        np.minimum.at(least, owner[todo], threshold[todo])
        asked = np.flatnonzero(np.isfinite(least))
        q, r, score = Index(rows, least[asked].min(), norm[asked].max()).above(queries[asked], least[asked])
        q = asked[q]
        good = allowed[q, r]
        q, r, score = q[good], r[good], score[good]
        order = np.lexsort((key[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first, last = np.searchsorted(q, owner[todo], "left"), np.searchsorted(q, owner[todo], "right")
        open_ = []
        for w, a, b in zip(todo, first, last):
            here = score[a:b]  # descending
            c = a + int(np.searchsorted(-here, -hi[w], "left"))
            d = a + int(np.searchsorted(-here, -threshold[w], "right"))
            if d - c >= want or level == LEVELS:
                if d > c:
                    out.append((int(w), r[c:min(d, c + want)], score[c:min(d, c + want)]))
            else:
                open_.append(w)
        todo = np.array(open_, int)
    return out


def matrix(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flattened integer vectors and where each begins (with the end of the last)."""
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    a = a.cast(pa.large_list(pa.int64()))
    off = np.asarray(a.offsets)
    return np.asarray(a.values)[off[0]:off[-1]], off - off[0]


def meet(group: pa.Table, same: bool, want: int) -> pa.Table:
    """The first ``want`` rows of every window of a cell's anchors among the cell's rows; see ``grid``."""
    flat, off = matrix(group["v"])
    size = np.diff(off)
    anchor = group["is_anchor"].to_numpy().astype(bool)
    row, label = group["row"].to_numpy(), group["label"].to_numpy()
    at = group["id"].fill_null(_LAST).to_numpy()
    lo, hi, window = (group[c].to_numpy() for c in ("lo", "hi", "window"))
    found = []
    for d in np.unique(size[anchor]):
        mine = np.flatnonzero(~anchor & (size == d))
        theirs = np.flatnonzero(anchor & (size == d))
        take = lambda rows: flat[(off[rows][:, None] + np.arange(d)).astype(np.int64)].reshape(len(rows), d)
        y = take(mine)
        key = np.empty(len(mine), np.int64)
        key[np.lexsort((row[mine], at[mine]))] = np.arange(len(mine))
        owners, owner = np.unique(row[theirs], return_inverse=True)
        lead = theirs[np.unique(owner, return_index=True)[1]]
        x = take(lead)
        # float products use BLAS and are exact as long as every sum stays below 2^53
        most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(int(d), 1)
        if most < _EXACT:
            x, y = x.astype(float), y.astype(float)
        for s in range(0, len(owners), AT_ONCE):
            w = np.flatnonzero((owner >= s) & (owner < s + AT_ONCE))
            some = lead[s:s + AT_ONCE]
            alike = label[some][:, None] == label[mine][None, :]
            allowed = alike & (row[some][:, None] != row[mine][None, :]) if same else ~alike
            for k, r, score in fill_windows(x[s:s + AT_ONCE], owner[w] - s, lo[theirs[w]], hi[theirs[w]], y, key, allowed, want):
                n = len(r)
                found.append((np.full(n, window[theirs[w[k]]]), row[mine[r]], np.asarray(score, np.int64)))
    cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ([], [], []))]
    return pa.table(dict(zip(("window", "row", "score"), (np.asarray(c, np.int64) for c in cols))))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def grid(rows: DataFrame, windows: DataFrame, same: bool, want: int) -> DataFrame:
    """(window, row, score): the best ``want`` of each cell for every window. ``windows`` has window, row (the anchor's),
    label, v, lo, hi; ``same`` seeks rows of the anchor's label, else those of other labels."""
    blocks = max(1, -(-rows.count() // ROWS))
    queries = max(1, -(-windows.select("row").distinct().count() // ANCHORS))
    dealt = rows.select(
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("r"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(queries - 1).cast("long"))).alias("a"), F.lit(False).alias("is_anchor"), "row", "id",
        "label", "v", *[F.lit(0).cast("long").alias(c) for c in ("window", "lo", "hi")])
    asked = windows.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("r"),
        F.pmod(F.xxhash64("row", F.lit(2)), F.lit(queries)).alias("a"), F.lit(True).alias("is_anchor"), "row",
        F.lit(None).cast("long").alias("id"), "label", "v", "window", "lo", "hi")
    return dealt.unionByName(asked).groupBy("r", "a").applyInArrow(lambda t: meet(t, same, want), "window long, row long, score long")


def best(found: DataFrame, ids: DataFrame, want: int) -> DataFrame:
    """The first ``want`` of every window over all cells, with their ids and ranks."""
    line = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.join(ids, "row").withColumn("rank", F.row_number().over(line))
    return ranked.filter(F.col("rank") <= want)


def mine(rows: DataFrame, anchors: Column, relabel: Column | None = None, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` (a condition
    on ``rows``) names: the first ``negatives`` rows of another label whose score lies between ``low`` and ``high`` percent
    of a positive's, for each of the first ``positives`` rows of the anchor's label. ``relabel`` replaces the label."""
    ship(rows.sparkSession)
    base = rows.filter(usable(rows[vector], rows[label])).select(
        rows[key].cast("long").alias("id"), F.coalesce(relabel, rows[label]).cast("long").alias("label") if relabel is not None
        else rows[label].cast("long").alias("label"), integers(rows[vector]).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    ids = base.select("row", "id")
    asks = base.filter("asks").select("row", "label", "v")
    whole = asks.select(F.col("row").alias("window"), "row", "label", "v", F.lit(-_LAST).alias("lo"), F.lit(_LAST).alias("hi"))
    near = best(grid(base, whole, True, positives), ids, positives)
    near = materialize(near.select(F.col("window").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
                       .withColumn("window", F.monotonically_increasing_id()), "positives")
    windows = near.join(asks.withColumnRenamed("row", "anchor"), "anchor").select(
        "window", F.col("anchor").alias("row"), "label", "v",
        F.expr(f"cast(ceil(cast({low} * cast(positive_score as decimal(20, 0)) as decimal(30, 0)) / 100) as long)").alias("lo"),
        F.expr(f"cast(floor(cast({high} * cast(positive_score as decimal(20, 0)) as decimal(30, 0)) / 100) as long)").alias("hi"))
    hard = best(grid(base, windows.filter("lo <= hi"), False, negatives), ids, negatives)
    named = near.join(ids.withColumnRenamed("row", "anchor").withColumnRenamed("id", "anchor_id"), "anchor")
    return hard.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "window").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
