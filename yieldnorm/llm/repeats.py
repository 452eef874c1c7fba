"""Passages that repeat across documents, found by column-wise construction of a collection's suffix order.

Every window of ``WINDOW`` bytes of a text is looked up among the windows of all texts; a byte goes if a window covers it
that also starts in a document with a smaller id. Four steps, all of whose shuffles are smaller than the texts:

1. Anchors. A window's anchor is the least hash of its ``GRAM``-byte substrings, so equal windows have equal anchors.
   Tasks send each anchor once for each stretch of text (packed, by hash range); anchors that only one text has are out.
2. Segments. Runs of windows with the same shared anchor in the same place are cut out of the texts (at most ``SPAN``
   windows); equal segments of a batch are one row with the list of their places. The rows are written as a table.
3. Suffix order. Segments are grouped by anchor, so equal windows meet in one group. A group is a collection of short
   strings whose Burrows-Wheeler transform is built column by column from the right, one symbol of every string a round
   (``collection_order``): each round reads the transform and the common prefixes of the round before once, in order, and
   writes them anew with the new suffixes in their places. A segment's anchor substring counts as one symbol, which
   shortens the strings. Suffixes that have a window's symbols in common are equal windows.
   An anchor with more than ``HOT`` segments is dealt by whole windows instead, which spreads it over the groups.
4. Each segment's windows get the least document that has them. Where a segment has one place, that gives spans at once;
   the others are joined to the list of their places, which a common passage makes long.

Groups are bounded (``GROUP_BYTES``, and a hot anchor's ``HOT`` segments), so a round's sequential files are kept as arrays
in memory.

A null text is empty; texts under ``WINDOW`` bytes keep everything. A null id counts as larger than all others and equal to
other nulls. Rows with the same id don't remove anything from each other; rows repeated with id and text get the same
result. Very long texts and very many copies need no special case. An empty table gives no rows. Columns other than id
and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..plans.sizing import broadcast_if_small, materialize
from .collocations import packed, unpacked
from .common import mix64, ship, utf8

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
#: Bytes of a stretch of text, segments that a task holds before it hands them on, and segments of a hash range (about).
STRETCH, HELD, MASS = 1 << 19, 1 << 20, 1 << 21
#: Bytes of a group of segments (about), segments of an anchor that stay together, and bytes of a broadcast side.
GROUP_BYTES, HOT, SENT_BYTES = 1 << 21, 20_000, 32 << 20
BITS, _LAST, LONG, _PLACE = 48, np.iinfo(np.int64).max, 1 << 20, np.uint64((1 << 20) - 1)
#: A row's place in a stretch takes 16 bits beside an anchor's 48.
_ROWS, _OPEN = 1 << 16, -1

_TABLE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(977))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and their inverses, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * STRETCH), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchored(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, row, core) of the segments of some texts (2^20 bytes at most): all their windows, in runs with
    the same least ``GRAM``-byte substring, which begins ``core`` bytes after the segment."""
    z = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return z, z, z.astype(np.uint64), z, z
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up)))
    gram = mix64((total[GRAM:] - total[:-GRAM]) * down[:len(data) - GRAM + 1])
    least = gram & ~_PLACE | np.arange(len(gram), dtype=np.uint64)  # ties go to the leftmost
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    cut = np.concatenate(([True], least[1:] != least[:-1]))
    for at in (off[:-1], off[1:] - WINDOW + 1):  # where a text's windows begin and end
        cut[at[(at >= 0) & (at < len(cut))]] = True
    start = np.flatnonzero(cut)
    windows = np.diff(np.append(start, len(least)))
    row = np.searchsorted(off, start, "right") - 1
    whole = start + WINDOW <= off[row + 1]
    start, windows, row = start[whole], windows[whole], row[whole]
    place = (least[start] & _PLACE).astype(np.int64)
    return start, windows, mix64(gram[place]) >> np.uint64(64 - BITS), row, place - start


def _stretches(texts: pa.Array):
    """(rows, data, offsets, first bytes) of stretches of texts; a text over ``LONG`` bytes is cut into stretches that share
    ``WINDOW`` - 1 bytes, so that each of its windows lies in one of them."""
    data, off = utf8(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + STRETCH, "right")) - 1), i + _ROWS, n)
        if off[j] - off[i] <= LONG:
            yield np.arange(i, j), data[off[i]:off[j]], off[i:j + 1] - off[i], np.zeros(j - i, np.int64)
        else:
            for a in range(int(off[i]), int(off[j]) - WINDOW + 1, LONG - WINDOW + 1):
                b = min(a + LONG, int(off[j]))
                yield np.array([i]), data[a:b], np.array([0, b - a]), np.array([a - off[i]])
        i = j


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without rows that repeat a key."""
    first = np.unique(batch.column("key").to_numpy(), return_index=True)[1]
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def send_anchors(batches, parts: int):
    """Step 1, map side: anchors that one text of a stretch has, with its key, and one entry for those that several have;
    the latter's texts are sent apart (``known``), dealt by key, as no other stretch is needed to know them as shared."""
    lift = np.uint64(BITS - parts.bit_length() + 1)

    def rows(part, h, code, keys, known, lone):
        used, place = np.unique(code, return_inverse=True)
        return {"part": int(part), "known": known, "hashes": packed(h), "lone": np.packbits(lone).tobytes(),
                "codes": place.astype("<u2").tobytes(), "keys": keys[used].tobytes()}

    def emit(pairs, keys):
        pairs = np.unique(np.concatenate(pairs))
        keys = np.concatenate(keys)
        h, code = pairs >> np.uint64(16), (pairs & np.uint64(_ROWS - 1)).astype(np.int64)
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        lone = np.diff(np.append(first, len(h))) == 1
        shared = ~np.repeat(lone, np.diff(np.append(first, len(h))))
        to = (mix64(keys[code[shared]].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        some_h, some_code = h[shared][order], code[shared][order]
        out = [rows(p, some_h[a:b], some_code[a:b], keys, True, np.zeros(1, bool)) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        h, code = h[first], code[first]
        cut = np.searchsorted(h, np.arange(parts + 1, dtype=np.uint64) << lift)
        out += [rows(p, h[a:b], code[a:b], keys, False, lone[a:b]) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pa.RecordBatch.from_pylist(out, pa.schema(
            [("part", pa.int64()), ("known", pa.bool_())] + [(c, pa.binary()) for c in ("hashes", "lone", "codes", "keys")]))

    pairs, keys, held, size = [], [], 0, 0
    for batch in batches:
        batch = _once(batch)
        names = batch.column("key").to_numpy().astype(np.int64)
        for at, data, off, _ in _stretches(batch.column("text")):
            if size and (size >= HELD or held + len(at) > _ROWS):
                yield emit(pairs, keys)
                pairs, keys, held, size = [], [], 0, 0
            _, _, h, row, _ = anchored(data, off)
            pairs.append((h << np.uint64(16)) | (row + held).astype(np.uint64))
            keys.append(names[at])
            held, size = held + len(at), size + len(h)
    if size:
        yield emit(pairs, keys)


def shared_anchors(group: pa.Table) -> pa.Table:
    """Step 1, reduce side: (key, anchor) of the anchors that several texts have."""
    out_k, out_h, all_h, all_k, all_lone = [], [], [], [], []
    for r in range(group.num_rows):
        h = unpacked(group["hashes"][r].as_py())
        keys = np.frombuffer(group["keys"][r].as_py(), np.int64)[np.frombuffer(group["codes"][r].as_py(), "<u2")]
        if group["known"][r].as_py():
            out_k.append(keys)
            out_h.append(h)
        else:
            all_h.append(h)
            all_k.append(keys)
            all_lone.append(np.unpackbits(np.frombuffer(group["lone"][r].as_py(), np.uint8), count=len(h)).astype(bool))
    if all_h:
        h, k, lone = np.concatenate(all_h), np.concatenate(all_k), np.concatenate(all_lone)
        order = np.argsort(h, kind="stable")
        h, k, lone = h[order], k[order], lone[order]
        size = np.diff(np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h)))
        wanted = lone & np.repeat(size > 1, size)
        out_k.append(k[wanted])
        out_h.append(h[wanted])
    return pa.table({"key": np.concatenate(out_k).astype(np.int64), "anchor": np.concatenate(out_h).astype(np.int64)})


def ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start:start + size] for each place, as a binary array."""
    off = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()),
                                                                           pa.py_buffer(flat.tobytes())])


def cut_segments(batches):
    """Step 2: the segments of the wanted anchors; equal ones are a row with the list of their places."""
    place = pa.struct([("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])

    def emit(parts):
        kinds = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        anchor, core, key, doc, at = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        which = kinds.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        first = np.flatnonzero(np.diff(which[order], prepend=-1))
        doc = doc[order]
        places = pa.StructArray.from_arrays([pa.array(key[order]), pa.array(doc), pa.array(at[order])], fields=list(place))
        return pa.record_batch({
            "anchor": pa.array(anchor[order][first].astype(np.int64)), "seg": kinds.dictionary.cast(pa.binary()),
            "core": pa.array(core[order][first].astype(np.int32)),
            "lo": pa.array(np.minimum.reduceat(doc, first)), "hi": pa.array(np.maximum.reduceat(doc, first)),
            "places": pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), places)})

    parts, size = [], 0
    for batch in batches:
        batch = _once(batch)
        key, doc = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "doc"))
        lists = batch.column("anchors").cast(pa.large_list(pa.int64()))
        begin, wanted = np.asarray(lists.offsets), np.asarray(lists.values).astype(np.uint64)
        for rows, data, off, skipped in _stretches(batch.column("text")):
            start, windows, h, row, core = anchored(data, off)
            mine = wanted[begin[rows[0]]:begin[rows[-1] + 1]]
            owner = np.repeat(np.arange(len(rows)), np.diff(begin[rows[0]:rows[-1] + 2])).astype(np.uint64)
            ok = np.isin((h << np.uint64(16)) | row.astype(np.uint64), (mine << np.uint64(16)) | owner)
            start, windows, h, row, core = start[ok], windows[ok], h[ok], row[ok], core[ok]
            if len(start):
                parts.append((ragged(data, start, windows + WINDOW - 1), h, core, key[rows[row]], doc[rows[row]],
                              start - off[row] + skipped[row]))
                size += len(start)
            if size >= HELD // 4:
                yield emit(parts)
                parts, size = [], 0
    if size:
        yield emit(parts)


def collection_order(flat: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of all suffixes with ``least`` symbols or more of the strings flat[off[i]:off[i + 1]], in
    their order; suffixes whose first ``least`` symbols are equal have the same class. Symbols are non-negative numbers
    below 2^31, strings shorter than 128.

    The transform starts with the empty suffixes. In round j the symbol before each string's suffix of length j is
    written into that suffix's place, which completes the order of the longer suffixes: a suffix cS stands among those
    that begin with c as S stands among the suffixes that follow a c. The common prefix of cS and its neighbour is one
    more than the least common prefix between S and the neighbour's rest."""
    n = len(off) - 1
    size = np.diff(off)
    low = np.int64((1 << 32) - 1)
    bwt, lcp = np.full(n, _OPEN, np.int32), np.zeros(n, np.uint8)
    name = np.arange(n, dtype=np.uint32) << np.uint32(7)  # string and length of a suffix
    heads = np.zeros(0, np.int64)  # first symbol of each non-empty suffix, and where its rest stands: rising
    who, place = np.arange(n), np.arange(n)
    for j in range(int(size.max(initial=0))):
        goes_on = size[who] > j
        who, place = who[goes_on], place[goes_on]
        symbol = flat[off[who + 1] - 1 - j].astype(np.int64)
        bwt[place] = symbol
        order = np.argsort(symbol, kind="stable")
        who, place, symbol = who[order], place[order], symbol[order]
        at = np.searchsorted(heads, symbol << 32 | place)  # the old suffix that each new one comes before
        first = np.concatenate(([True], (at[1:] != at[:-1]) | (symbol[1:] != symbol[:-1])))
        around = np.concatenate(([-1], heads, [-1]))
        before, after = around[at], around[at + 1]
        left = ~first | (before >> 32 == symbol)
        right = np.append(first[1:], True) & (after >> 32 == symbol)
        before = np.where(first, before & low, np.concatenate(([0], place[:-1])))
        common = _range_least(lcp, np.concatenate((before[left], place[right])) + 1,
                              np.concatenate((place[left], after[right] & low)) + 1) + 1
        ours = np.zeros(len(who), np.uint8)
        ours[left] = common[:left.sum()]
        ins = n + at + np.arange(len(at))
        old = np.ones(len(bwt) + len(ins), bool)
        old[ins] = False
        moved = np.flatnonzero(old)  # where the old suffixes stand now
        bwt, lcp, heads, name = (
            _merged(old, bwt, ins, _OPEN), _merged(old, lcp, ins, ours),
            _merged(old[n:], heads & ~low | moved[heads & low], ins - n, symbol << 32 | moved[place]),
            _merged(old, name, ins, (who.astype(np.uint32) << np.uint32(7)) | np.uint32(j + 1)))
        lcp[ins[right] + 1] = common[left.sum():]
        place = ins
    length = (name & np.uint32(127)).astype(np.int64)
    long = length >= least
    string = (name >> np.uint32(7)).astype(np.int64)
    return string[long], (size[string] - length)[long], np.cumsum(lcp < least)[long]


def _merged(old: np.ndarray, was: np.ndarray, ins: np.ndarray, value) -> np.ndarray:
    """``was`` at the places ``old`` of a new array, ``value`` at the others."""
    now = np.empty(len(old), was.dtype)
    now[old] = was
    now[ins] = value
    return now


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair with lo < hi."""
    order = np.argsort(-lo)  # falling starts: the stretch between one query's end and the next one's start is not read
    ends = np.empty(2 * len(lo), np.int64)
    ends[0::2], ends[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), np.uint8)
    if len(lo):
        out[order] = np.minimum.reduceat(np.append(values, np.uint8(0)), ends)[0::2]
    return out


def collapsed(kinds: pa.Array, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments as strings of symbols, with their anchor's ``GRAM`` bytes as one symbol: all windows of a segment hold
    them, at the same place in equal windows."""
    off = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset:kinds.offset + len(kinds) + 1]
    flat = np.frombuffer(kinds.buffers()[2], np.uint8)
    grams = ragged(flat, off[:-1] + core, np.full(len(core), GRAM)).dictionary_encode().indices.to_numpy()
    symbols = flat[off[0]:off[-1]].astype(np.int32)
    at = off[:-1] - off[0] + core
    symbols[at] = 256 + grams
    keep = np.ones(len(symbols), bool)
    keep[(at[:, None] + np.arange(1, GRAM)).reshape(-1)] = False
    return symbols[keep], off - off[0] - np.arange(len(off)) * (GRAM - 1)


def match_windows(group: pa.Table) -> pa.Table:
    """Step 3: runs of windows of the segments that a document below the segment's largest has. A segment with one place
    (``key``) gives spans of bytes there; of others (``sid``), runs start..stop of windows with their least document."""
    kinds = group["seg"].cast(pa.large_binary()).combine_chunks().dictionary_encode()
    which = kinds.indices.to_numpy()
    lo, hi, where = (group[c].to_numpy() for c in ("lo", "hi", "where"))
    at, core = where >> 8, where & 255
    n = len(kinds.dictionary)
    cores = np.zeros(n, np.int64)
    cores[which] = core
    least = np.full(n, _LAST)
    np.minimum.at(least, which, lo)
    string, start, kind = collection_order(*collapsed(kinds.dictionary, cores), WINDOW - GRAM + 1)
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    value = np.repeat(np.minimum.reduceat(least[string], first), np.diff(np.append(first, len(kind)))) if len(kind) else least[:0]
    best = np.full((n, SPAN), _LAST)
    best[string, start] = value
    got = best[which]
    ok = got < hi[:, None]
    go = ok & np.concatenate((np.ones((len(got), 1), bool), ~ok[:, :-1] | (got[:, 1:] != got[:, :-1])), 1)
    stop = ok & np.concatenate((~ok[:, 1:] | (got[:, 1:] != got[:, :-1]), np.ones((len(got), 1), bool)), 1)
    r, a = np.nonzero(go)
    b = np.nonzero(stop)[1]
    found = group.select(["key", "sid"]).take(pa.array(r))
    return pa.table({"key": found["key"], "sid": found["sid"], "doc": pa.array(hi[r]), "least": pa.array(got[r, a]),
                     "start": pa.array(a + at[r]), "stop": pa.array(b + at[r] + WINDOW)})


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
CUT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("spans", SPANS),
                  StructField("kept_sha256", StringType())])


@arrow_udf(SPANS)
def united(lists: pa.Array) -> pa.Array:
    """Spans that touch or overlap as one, in order."""
    lists = lists.cast(pa.large_list(lists.type.value_type))
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    start, stop = (np.asarray(x) for x in lists.flatten().flatten())
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # a row's numbers lie above those of the rows before it, so one running maximum serves all rows
    above = row * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + above)
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | ((start + above)[1:] > reach[:-1])))) if len(row) else order
    ends = np.append(first[1:] - 1, len(row) - 1) if len(first) else first
    spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach - above)[ends])], ["start", "stop"])
    off = np.searchsorted(row[first], np.arange(len(lists) + 1))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), spans)


@arrow_udf(CUT)
def cut_out(texts: pa.Array, lists: pa.Array) -> pa.Array:
    data, off = utf8(texts)
    out = []
    for i, found in enumerate(lists.to_pylist()):
        text, kept, spans, end = data[off[i]:off[i + 1]], hashlib.sha256(), found or [], 0
        for s in spans:
            kept.update(text[end:s["start"]].tobytes())
            end = s["stop"]
        kept.update(text[end:].tobytes())
        out.append({"n_removed": sum(s["stop"] - s["start"] for s in spans), "n_spans": len(spans), "spans": spans,
                    "kept_sha256": kept.hexdigest()})
    return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), (
        "spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())]))


def repeated_spans(base: DataFrame) -> DataFrame:
    """key, doc, found (start, stop: bytes, in order) of the texts of ``base`` (key, doc, text) that repeat others."""
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 << max(0, (size // (14 * MASS))).bit_length()  # an anchor for every 14 bytes or so
    sent = base.select("key", "text").mapInArrow(
        lambda b: send_anchors(b, parts), "part long, known boolean, hashes binary, lone binary, codes binary, keys binary")
    wanted = sent.groupBy("part").applyInArrow(shared_anchors, "key long, anchor long")
    # about as large as the texts, so never broadcast
    wanted = wanted.groupBy("key").agg(F.collect_set("anchor").alias("anchors")).hint("shuffle_merge")
    cut = base.join(wanted, "key").select("key", "doc", "text", "anchors").mapInArrow(
        cut_segments, "anchor long, seg binary, core int, lo long, hi long, places array<struct<key: long, doc: long, at: long>>")
    segments = materialize(cut.withColumn("sid", F.monotonically_increasing_id()), "segments", compression="zstd")

    total = segments.agg(F.coalesce(F.sum(F.octet_length("seg")), F.lit(0))).first()[0]
    groups = total // GROUP_BYTES + 1
    hot = materialize(segments.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    one = F.size("places") == 1
    marked = segments.select("anchor", "seg", "core", "lo", "hi", F.when(one, F.col("places")[0]["key"]).alias("key"),
                             F.when(one, F.col("places")[0]["at"]).otherwise(0).alias("at"), F.when(~one, F.col("sid")).alias("sid"))
    marked = marked.join(broadcast_if_small(hot, row_bytes=32)[0], "anchor", "left")
    single = F.posexplode(F.when(F.col("hot"), F.transform(
        F.sequence(F.lit(0), F.octet_length("seg") - WINDOW), lambda i: F.substring(F.col("seg"), i + 1, F.lit(WINDOW)))
    ).otherwise(F.array("seg"))).alias("shift", "window")
    dealt = marked.select("*", single).select(
        F.pmod(F.when(F.col("hot"), F.xxhash64("window")).otherwise(F.xxhash64("anchor")), F.lit(groups)).alias("g"),
        "key", "sid", F.col("window").alias("seg"), "lo", "hi",
        (F.shiftleft(F.col("at") + F.col("shift"), 8) + (F.col("core") - F.col("shift"))).alias("where"))
    found = materialize(dealt.groupBy("g").applyInArrow(
        match_windows, "key long, sid long, doc long, least long, start long, stop long"), "runs", compression="zstd")
    alone = found.filter("key is not null").select("key", "doc", "start", "stop")
    runs = found.filter("sid is not null").groupBy("sid").agg(F.collect_list(F.struct("start", "stop", "least")).alias("runs"))
    each = segments.filter(F.size("places") > 1).select("sid", "places").join(runs, "sid").select("runs", F.explode("places").alias("p"))
    each = each.select("p", F.explode("runs").alias("r")).filter(F.col("r.least") < F.col("p.doc"))
    each = each.select("p.key", "p.doc", (F.col("p.at") + F.col("r.start")).alias("start"), (F.col("p.at") + F.col("r.stop")).alias("stop"))
    spans = alone.unionByName(each).groupBy("key", "doc").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    return spans.withColumn("found", united("found"))


def mark_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in UTF-8 bytes) of what
    repeats a document with a smaller id."""
    ship(docs.sparkSession)
    base = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[key].cast("long"), F.lit(_LAST)).alias("doc"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("doc", "text"))
    spans = materialize(repeated_spans(base.select("key", "doc", "text")), "spans")
    n = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    side, _ = broadcast_if_small(spans, row_bytes=64 + 24 * (n[1] // max(1, n[0])), max_bytes=SENT_BYTES)
    rows = base.join(side, ["key", "doc"], "left").withColumn("cut", cut_out("text", "found"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans",
                       "cut.kept_sha256", "cut.spans")
