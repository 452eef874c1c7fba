"""Packing token ids into windows of near-equal fill by Karmarkar-Karp multiway differencing.

A document's ids, with ``end_id`` after them, are cut into pieces: whole windows, and what remains into pieces of at
most ``max_piece``. Remaining pieces are dealt at random, by a hash of a stored row number, to groups of about
``GROUP_WINDOWS`` windows. In a group, tiny pieces are first chained into items; then each item is a partition of its
own into k windows, and the two partitions with the largest spread are merged again and again, the fullest window of
one with the emptiest of the other. k starts at the least number of windows that could hold the group and rises
whenever a window exceeds the capacity.

Null and empty texts have only ``end_id``. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..plans.sizing import materialize
from . import bpe
from .common import SLICE_BYTES, give_back, ship, slices, text_or_empty, utf8

WINDOW, END_ID, MAX_PIECE, GROUP_WINDOWS = 4096, 2, 1024, 256
#: Pieces shorter than this are chained into items of about this length before differencing.
ITEM_TOKENS = 256


def cuts(n: int, window: int = WINDOW, max_piece: int = MAX_PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then near-equal pieces of at most ``max_piece``."""
    full, rest = divmod(n, window)
    out = [(i * window, window) for i in range(full)]
    if rest:
        k = -(-rest // max_piece)
        at = [full * window + rest * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(at, at[1:])]
    return out


def cut_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, max_piece: int = MAX_PIECE,
                  with_ids: bool = False, text: str = "text", key: str = "doc_id",
                  max_runs: int = bpe.MAX_RUNS, keep: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids. A worker keeps a table of
    ``max_runs`` runs of text that it has encoded, from task to task if ``keep``."""
    fields = [StructField("doc_id", docs.schema[key].dataType)]
    fields += [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [StructField("ids", ArrayType(LongType()))] * with_ids

    def cut(batches):
        encoder = bpe.shared(bpe.WordEncoder, path, max_runs)
        for batch in batches:
            texts = batch.column(1)
            _, off = utf8(texts)
            for i, j in slices(off, 4 * SLICE_BYTES):
                who, start, length, crc, total, ids = [], [], [], [], [], []
                for k, t in enumerate(encoder.ids(texts[i:j]), i):
                    t = np.append(t, np.uint32(end_id)).astype("<u4")
                    raw = memoryview(t).cast("B")
                    for a, n in cuts(len(t), window, max_piece):
                        who.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * a:4 * (a + n)]))
                        total.append(len(t))
                        if with_ids:
                            ids.append(t[a:a + n].astype(np.int64))
                cols = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if not keep:
            del encoder
            bpe.release()
            give_back()

    return docs.select(docs[key], text_or_empty(docs, text)).mapInArrow(cut, StructType(fields))


def difference(size: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each item, by multiway differencing."""
    n = len(size)
    left, right = list(range(n)), [-1] * n  # nodes: items first, then unions of two nodes
    heap, parts = [], {}
    for i in np.argsort(-size, kind="stable"):
        sums, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], node[0] = size[i], i
        parts[int(i)] = (sums, node)
        heap.append((-int(size[i] if k > 1 else 0), int(i)))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(a), parts.pop(b)
        sb, nb = sb[::-1], nb[::-1]  # fullest of a meets emptiest of b
        sums, node = sa + sb, np.maximum(na, nb)
        for j in np.flatnonzero((na >= 0) & (nb >= 0)):
            left.append(int(na[j]))
            right.append(int(nb[j]))
            node[j] = len(left) - 1
        o = np.argsort(-sums, kind="stable")
        sums, node = sums[o], node[o]
        parts[fresh] = (sums, node)
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), fresh))
        fresh += 1
    out = np.zeros(n, np.int64)
    (_, node), = parts.values()
    for w, top in enumerate(node):
        stack = [int(top)] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += [left[x], right[x]]
    return out


def pack_group(length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece of a group."""
    length = np.asarray(length, np.int64)
    if not len(length):
        return length, length
    item = np.arange(len(length))
    tiny = np.flatnonzero(length < ITEM_TOKENS)
    if len(tiny):
        chain = np.concatenate(([0], np.cumsum(length[tiny])[:-1])) // ITEM_TOKENS  # chains of under 2 * ITEM_TOKENS
        item[tiny] = len(length) + chain
    _, item = np.unique(item, return_inverse=True)
    size = np.bincount(item, weights=length).astype(np.int64)
    k = int(-(-size.sum() // window))
    while True:
        of = difference(size, k)
        if np.bincount(of, weights=size, minlength=k).max() <= window:
            break
        k += 1
    place = of[item]
    o = np.lexsort((np.arange(len(length)), place))
    end = np.cumsum(length[o])
    head = np.concatenate(([True], place[o][1:] != place[o][:-1]))
    base = np.maximum.accumulate(np.where(head, end - length[o], 0))
    offset = np.empty_like(length)
    offset[o] = end - length[o] - base
    return place, offset


def place_pieces(pieces: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """``pieces`` with sequence_id and offset. What reaches the driver is one sum."""
    rows = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    rest = F.col("length") < window
    total = rows.filter(rest).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, round(total / (window * group_windows)))
    whole = rows.filter(~rest).select(*rows.columns, (F.col("piece") * 2).alias("sequence_id"),
                                      F.lit(0).cast("long").alias("offset"))
    keyed = rows.filter(rest).select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        place, offset = pack_group(table["length"].to_numpy(), window)
        ids = (table["group"].to_numpy() * (1 << 24) + place) * 2 + 1
        return pa.table({"piece": table["piece"], "sequence_id": ids, "offset": offset})

    placed = keyed.groupBy("group").applyInArrow(pack, "piece long, sequence_id long, offset long")
    return whole.unionByName(rows.filter(rest).join(placed, "piece")).drop("piece")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, max_piece: int = MAX_PIECE,
         group_windows: int = GROUP_WINDOWS, with_ids: bool = False, text: str = "text", key: str = "doc_id",
         max_runs: int = bpe.MAX_RUNS, keep: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset and, if asked for, ids."""
    ship(docs.sparkSession)
    made = cut_documents(docs, path, window, end_id, max_piece, with_ids, text, key, max_runs, keep)
    return place_pieces(made, window, group_windows)
