"""Near-duplicates by BagMinHash signatures, bands and verified multiset overlap.

A text's bag holds its shingles: every ``SHINGLE`` words running (words are lower-cased and parted by ASCII white
space), each with the number of times it occurs; a shorter text has one shingle of all its words. Each (shingle, octave of weights) has its own Poisson process,
seeded by the shingle; octaves are [0, 1), [1, 2), [2, 4), ... and a point is kept where its level lies under the
shingle's weight, so that a bag's points are those of its discretised weights. A kept point belongs to one of ``SIZE``
components; a component's minimum agrees between two bags with probability equal to their weighted Jaccard
similarity. Only points below a bound are made; where a component stays empty, the bound is doubled.

Signatures are cut into bands. Texts that share a band are candidates, compared by the exact overlap of their bags,
sum of minima over sum of maxima, ``>= threshold``. First every member of a band's bucket is compared with the member
that has the most company over all its buckets, and classes are formed. Then, where a bucket still holds several
classes, tasks compare texts of different classes over blocks of at most ``BLOCK`` texts: pairs whose signatures agree
far too little (by five standard deviations) are passed over, pairs whose classes have met meanwhile too, the others
are verified, each in the first band that both share. Only links come out; pairs are never listed. Classes are
connected components.

Texts that are equal when lower-cased are one class and are compared once (null is empty). A text without words
(empty, white space) is linked with nothing but equal texts. Of a class the row with the least doc_id stays (null last, then any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, DoubleType

from ..plans.sizing import broadcast_if_small, materialize
from . import bpe
from .common import SLICE_BYTES, fresh, give_back, mix64, ship, slices, text_or_empty, utf8, word_bounds, word_hashes
from .components import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 5
SIZE = BANDS * ROWS
#: Texts of so many bytes are signed at once.
SIGN_BYTES = SLICE_BYTES
#: Texts of a block, and rows and bytes of text that a task's group holds (about).
BLOCK, GROUP_ROWS, GROUP_BYTES = 1024, 2000, 8 << 20
#: Candidate texts' keys are broadcast up to this size, else the join shuffles.
KEY_BYTES = 64 << 20
_UNIT = 1 << 36  # fixed-point unit of arrival times, so that their sums are exact
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def bags(texts: pa.Array, shingle: int = SHINGLE, most: int = SIGN_BYTES):
    """(first row, end row, row, shingle hash, count) over slices of the texts; rows rise, hashes rise within a row."""
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    for i, j in slices(off, most):
        d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, row = word_bounds(d, o)
        w = word_hashes(d, start, end)
        n = np.bincount(row, minlength=j - i)
        first = np.cumsum(n) - n
        length = np.minimum(n, shingle)[row]
        place = np.arange(len(w)) - first[row]
        head = np.flatnonzero(place + length <= n[row])
        h = length[head].astype(np.uint64)
        for k in range(shingle):
            here = np.minimum(head + k, len(w) - 1)
            h = np.where(k < length[head], mix64(h * _ODD[k % len(_ODD)] + w[here]), h)
        r = row[head]
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))) if len(r) else order
        yield i, j, r[new], h[new], np.diff(np.append(new, len(r)))


def _arrival(seed: np.ndarray, k, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time of the k-th point of a process with rate ``length``, in fixed point, and the point's random bits."""
    bits = mix64(seed + _ODD[0] * np.asarray(k, np.uint64) + np.uint64(1))
    u = ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
    return np.floor(-np.log(u) / length * _UNIT).astype(np.int64), bits


def signatures(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """A signature of ``size`` bytes for each bag; bags without shingles get zeros."""
    out = np.zeros((rows, size), np.uint8)
    weight = np.bincount(row, w, rows)
    # one process for each octave of weights below w: [0, 1), [1, 2), [2, 4), ...
    octaves = np.where(w <= 1, 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1)
    which = np.repeat(np.arange(len(h)), octaves)
    octave = np.arange(len(which)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0))
    length = np.maximum(low, 1)
    seed = mix64(h[which] + _ODD[1] * octave.astype(np.uint64))
    owner, top = row[which], w[which]
    bound = np.where(weight > 0, size / np.maximum(weight, 1) * (np.log(size) + 3) * _UNIT, 0).astype(np.int64)
    todo, pending = np.arange(len(which)), weight > 0
    while len(todo):
        best = np.full(rows * size, np.iinfo(np.int64).max)
        at, time, k = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        block = np.ones(len(todo), np.int64)
        while len(at):
            rep = np.repeat(np.arange(len(at)), block)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(block) - block, block)
            src = at[rep]
            wait, bits = _arrival(seed[src], k[rep] + step, length[src])
            total = np.cumsum(wait)
            ends = np.cumsum(block) - 1
            base = np.concatenate(([0], total[ends[:-1]]))
            t = total - base[rep] + time[rep]
            limit = bound[owner[src]]
            ok = t <= limit
            bits = mix64(bits[ok])
            s, tt = src[ok], t[ok]
            level = low[s] + (((bits >> np.uint64(32)) * length[s].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            comp = (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            keep = level < top[s]
            np.minimum.at(best, owner[s[keep]] * size + comp[keep], tt[keep])
            go = ok[ends]  # the block's last point is still below the bound
            at, time, k = at[go], t[ends][go], k[go] + block[go]
            left = (bound[owner[at]] - time) * length[at] / _UNIT
            block = np.ceil(left * 1.2).astype(np.int64) + 3
        best = best.reshape(rows, size)
        full = pending & (best.max(1) < np.iinfo(np.int64).max)
        out[full] = (mix64(best[full].astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        pending &= ~full
        bound *= 2
        todo = np.flatnonzero(pending[owner])
    return out


def sign(texts: pa.Array) -> pa.Array:
    """Signature of each text, null where it has no words."""
    out = []
    for i, j, row, h, n in bags(texts):
        some = np.bincount(row, minlength=j - i) > 0
        sig = signatures(row, h, n, j - i)
        out += [s.tobytes() if ok else None for s, ok in zip(sig, some)]
    return pa.array(out, pa.binary())


def _bag_list(texts: pa.Array) -> list:
    out = []
    for i, j, row, h, n in bags(texts):
        ends = np.searchsorted(row, np.arange(j - i + 1))
        out += [(h[a:b], n[a:b]) for a, b in zip(ends, ends[1:])]
    return out


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags (hashes in order, counts); 0 if either is empty."""
    (ha, na), (hb, nb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    common = int(np.minimum(na[both], nb[at[both]]).sum())
    return common / (int(na.sum()) + int(nb.sum()) - common)


@arrow_udf(DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    kinds = pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())]).dictionary_encode()
    made, at, n = _bag_list(kinds.dictionary), kinds.indices.to_numpy(), len(left)
    out = pa.array([overlap(made[a], made[b]) for a, b in zip(at[:n], at[n:])], pa.float64())
    del kinds, made
    give_back()
    return out


@arrow_udf(BinaryType())
def signature(texts: pa.Array) -> pa.Array:
    bpe.release()  # a worker that packed or counted tokens before would keep its tables beside the signatures
    out = sign(texts)
    give_back()
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) overlap enough."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("s", similarity("ta", "tb")).filter(F.col("s") >= threshold).select("a", "b")


def _cell_links(sig: np.ndarray, label: np.ndarray, text: pa.Array, one: np.ndarray, two: np.ndarray, band: int,
                threshold: float) -> list[tuple[int, int]]:
    """Links (positions) between texts of different classes in a cell: ``one`` against ``two``, or within one block."""
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / SIZE)
    within = one is two
    found = []
    step = max(1, (4 << 20) // (SIZE * len(two)))
    for a in range(0, len(one), step):
        i = one[a:a + step]
        equal = sig[i][:, None, :] == sig[two][None, :, :]
        agree = equal.mean(2)
        wanted = (agree >= least) & (label[i][:, None] != label[two][None, :])
        if within:
            wanted &= np.arange(a, a + len(i))[:, None] < np.arange(len(two))[None, :]
        x, y = np.nonzero(wanted)
        first = equal[x, y].reshape(len(x), BANDS, ROWS).all(2).argmax(1) == band
        found.append(np.stack([agree[x, y][first], i[x[first]], two[y[first]]]))
    found = np.concatenate(found, 1)
    if not found.shape[1]:
        return []
    root = {int(c): int(c) for c in label}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    used = np.unique(found[1:].astype(np.int64))
    bag = dict(zip(used.tolist(), _bag_list(text.take(pa.array(used)))))
    out = []
    for k in np.argsort(-found[0], kind="stable"):
        i, j = int(found[1, k]), int(found[2, k])
        p, q = top(int(label[i])), top(int(label[j]))
        if p != q and overlap(bag[i], bag[j]) >= threshold:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def compare_cells(group: pa.Table, threshold: float) -> pa.Table:
    """Links (a, b: rows) found in the cells of a group; see ``classes``."""
    bpe.release()
    no, band, lo, hi, mine, row, label = (group[c].to_numpy() for c in ("no", "band", "lo", "hi", "block", "row", "component"))
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(row), SIZE)
    text = group["text"].cast(pa.large_string()).combine_chunks()  # stays in Arrow: only texts of likely pairs are read
    order = np.lexsort((row, hi, lo, band))
    cell = np.stack([band, lo, hi])[:, order]
    ends = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(0), [True])))
    links = []
    for s, e in zip(ends, ends[1:]):
        at = order[s:e]
        one, two = at[mine[at] == lo[at]], at[mine[at] == hi[at]]
        if lo[at[0]] == hi[at[0]]:
            two = one
        if len(one) and len(two):
            links += _cell_links(sig, label, text, one, two, int(no[at[0]]), threshold)
    pairs = np.array(links, np.int64).reshape(len(links), 2)
    out = pa.table({"a": row[pairs[:, 0]], "b": row[pairs[:, 1]]})
    del sig, text
    give_back()
    return out


def cells_of(mixed: DataFrame) -> DataFrame:
    """Members (no, band, row, component) of buckets dealt to cells: a block of a bucket meets every block of it."""
    n = mixed.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    out = mixed.join(n, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    out = out.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.select("no", "band", "row", "component", "block", F.least("block", "other").alias("lo"),
                      F.greatest("block", "other").alias("hi"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, node (hash of the lower-cased text), row, class_id (the least doc_id of the
    class), kept (one row of each class), class_size."""
    ship(docs.sparkSession)
    node = F.unhex(F.md5(F.lower(text_or_empty(docs, text))))
    base = docs.select(docs[key].alias("doc_id"), text_or_empty(docs, text).alias("text"), node.alias("node"))
    signed = materialize(base.select("doc_id", "node", signature("text").alias("sig"))
                         .withColumn("row", F.monotonically_increasing_id()), "signatures")
    group = materialize(signed.groupBy("node").agg(F.min("row").alias("rep")), "texts")
    reps = signed.join(group.select(F.col("rep").alias("row")), "row", "left_semi").filter("sig is not null")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                        lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * ROWS + 1, F.lit(ROWS))))
    bands = materialize(reps.select("row", F.posexplode(bands).alias("no", "band")), "bands")
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(bands.join(buckets, "band"), "members")
    company = members.groupBy("row").agg(F.sum("n").alias("company"))
    leads = members.join(company, "row").groupBy("band").agg(F.max(F.struct("company", "row"))["row"].alias("lead"))
    pairs = members.join(leads, "band").filter("row <> lead")
    tried = materialize(pairs.select(F.least("lead", "row").alias("a"), F.greatest("lead", "row").alias("b")).distinct(), "pairs")
    wanted = members.select("row").distinct()
    wanted = materialize(wanted.join(signed, "row").select("row", "doc_id", "node"), "wanted")
    small, _ = broadcast_if_small(wanted, row_bytes=48, max_bytes=KEY_BYTES)
    found = small.withColumnRenamed("node", "n").withColumnRenamed("doc_id", "d")
    same = (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))
    # repeated rows match one wanted row more than once; their texts are equal when lower-cased
    texts = base.join(found, same).select("row", "text")
    texts = materialize(texts.groupBy("row").agg(F.first("text").alias("text")), "candidates")
    links = materialize(verified(tried, texts, threshold), "links")
    first = components(links)

    # buckets that hold several classes
    placed = members.select("no", "band", "row").join(first.withColumnRenamed("node", "row"), "row", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "row")), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    cells = materialize(cells_of(placed.join(mixed.select("band"), "band", "left_semi")), "cells")
    sizes = texts.select("row", F.octet_length("text").alias("size"))
    held = cells.join(sizes, "row").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    groups = max(1, -(-held["n"] // GROUP_ROWS), -(-held["size"] // GROUP_BYTES))
    full = cells.join(signed.select("row", "sig"), "row").join(texts, "row")
    dealt = full.withColumn("g", F.pmod(F.xxhash64("band", "lo", "hi"), F.lit(groups)))
    more = dealt.groupBy("g").applyInArrow(lambda t: compare_cells(t, threshold), "a long, b long")
    final = components(links.unionByName(more))

    group = group.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    group = group.select("node", F.coalesce("component", "rep").alias("component"))
    rows = materialize(signed.select("doc_id", "node", "row").join(group, "node"), "classes")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("best"),
                                         F.count(F.lit(1)).alias("class_size"))
    # written, so that the join can split a class that holds many rows
    return rows.join(materialize(best, "best"), "component").select(
        "doc_id", "node", "row", F.col("best.doc_id").alias("class_id"),
        (F.col("row") == F.col("best.row")).alias("kept"), "class_size")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    n, k, t, r, mine, own = fresh(docs, "node_", "key_", "times_", "row_", "own_node_", "own_key_")
    kept = classes(docs, threshold, text, key)
    kept = kept.groupBy("node", "doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias(t)).filter("stays")
    kept = kept.select(F.col("node").alias(n), F.col("doc_id").alias(k), t)
    rows = docs.select("*", F.unhex(F.md5(F.lower(text_or_empty(docs, text)))).alias(mine), docs[key].alias(own))
    rows = rows.join(kept, (F.col(mine) == F.col(n)) & F.col(own).eqNullSafe(F.col(k)))
    once = rows.filter(F.col(t) == 1).select(docs.columns)
    # rows repeated with the same doc_id and text: one stays, reduced map-side
    repeated = rows.filter(F.col(t) > 1).groupBy(n, k).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(r))
    return once.unionByName(repeated.select(*[F.col(r)[c].alias(c) for c in docs.columns]))
