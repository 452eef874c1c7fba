"""Phrase collocations: word sequences that occur together more often than their parts, for each language.

Texts are lower-cased (A-Z only) and split at ``BREAKS`` into pieces and those at blanks and tabs into words. A phrase is 1
to ``LONGEST`` contiguous words of a piece. Two passes count the phrases with ``threshold`` occurrences or more.

First pass: each task hashes the phrases of a stretch of text to 48 bits and sums equal ones; the hash space is cut into
partitions of a bounded mass. A partition's counts are folded into a Misra-Gries summary, which merges two summaries by
adding equal counters and, when more than its capacity are left, taking the largest counter that must go from all of
them. The capacity is ``SPARE`` times the partition's mass divided by the threshold, so that what was taken from any
counter stays below threshold / ``SPARE``: every phrase with ``threshold`` occurrences survives, whatever else it shares
its hash with.

Second pass: phrases whose hash survived are counted exactly by their words. The survivors reach the tasks as a bitmap of
at most ``FILTER_BITS`` bits; with more than ``PER_ROUND`` survivors the hash space is counted in several rounds, each
with a bitmap of its own, so the broadcast doesn't grow with the corpus. What passes the bitmap by chance only adds
rows to the exact count.

Candidates have 2 words or more. A cut after k words gives l and r, the counts of both parts, and
floor(2,000,000 * a / (l + r)) in exact decimals; the lowest cut counts, ties to the least k. A candidate goes if a longer
one that contains it has at least ``COVERED`` percent of its count.

A null text is empty, a null language is ``und`` (as one that is named so). Empty texts and empty tables give no rows.
Very long texts are stretches of their own. Repeated rows count as often as they occur. Columns other than text and
language are not read, whatever their names. Ties: see ``top_phrases``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import materialize
from .common import mix64, ship, slices, utf8, word_hashes

LONGEST, THRESHOLD, COVERED, FACTOR, TOP = 4, 30, 80, 2_000_000, 2000
#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Capacity of a summary in multiples of mass / threshold, phrases of a partition (about), bytes of a stretch of text, and
#: phrases that a task sums before it hands them on.
SPARE, MASS, STRETCH, HELD = 4, 1 << 23, 1 << 19, 1 << 21
FILTER_BITS, PER_ROUND = 28, 1 << 24
BITS = 48

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of a stretch of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, language: np.ndarray):
        data = _LOWER[data]
        gap = _BREAK[data] | _BLANK[data]
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True
        first = first[:-1]
        inside = ~gap
        start = np.flatnonzero(inside & (first | np.concatenate(([True], gap[:-1])))) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & np.concatenate((first[1:] | gap[1:], [True]))) + 1 if len(data) else start
        row = np.searchsorted(off, start, "right") - 1
        # pieces: a number that rises at every break and at every row
        broken = np.cumsum(_BREAK[data] | first) if len(data) else np.zeros(0, np.int64)
        self.data, self.start, self.end, self.row, self.piece = data, start, end, row, broken[start]
        self.language = language[row]
        self.hash = word_hashes(data, start, end)

    def phrases(self, n: int) -> np.ndarray:
        """The first words of all phrases of ``n`` words."""
        if len(self.start) < n:
            return np.zeros(0, np.int64)
        last = len(self.start) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:])

    def hashes(self, first: np.ndarray, n: int, seed: np.ndarray, kind: int = 0) -> np.ndarray:
        """64-bit hashes of phrases within their language; another ``kind`` is independent."""
        h = seed[self.language[first]] + _ODD[1:2] * np.uint64(n + 8 * kind)
        for k in range(n):
            w = self.hash[first + k]
            h = mix64(h * _ODD[0] + (w if kind == 0 else mix64(w ^ _ODD[2])))
        return h

    def strings(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        """The phrases as text, their words joined by one blank."""
        count = n[:, None] > np.arange(LONGEST)
        which = (first[:, None] + np.arange(LONGEST))[count]
        size = self.end[which] - self.start[which] + 1  # with the blank after it
        at = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(at[-1]) - np.repeat(at[:-1], size)
        out = np.full(at[-1], 0x20, np.uint8)
        letters = place < np.repeat(size - 1, size)
        out[letters] = self.data[(np.repeat(self.start[which], size) + place)[letters]]
        ends = at[np.cumsum(n)]
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        off = np.concatenate(([0], ends - np.arange(1, len(n) + 1))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off.tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def stretches(batch: pa.RecordBatch):
    """(words, seed of each language, languages) for stretches of a batch of (language, text)."""
    names = batch.column("language").dictionary_encode()
    data, off = utf8(pa.array(["\0" + x for x in names.dictionary.to_pylist()], pa.string()))  # the empty name has a hash, too
    seed = word_hashes(data, off[:-1], off[1:])
    code = names.indices.to_numpy()
    data, off = utf8(batch.column("text"))
    for i, j in slices(off, STRETCH):
        lo, hi = off[i], off[j]
        yield Words(data[lo:hi], off[i:j + 1] - lo, code[i:j]), seed, names.dictionary


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def packed(h: np.ndarray) -> bytes:
    """Sorted numbers as the first one and differences, the lowest bytes of all differences first; see ``unpacked``."""
    d = np.diff(h)
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + h[:1].tobytes() + d.view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1)
    d = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    d[1:, :width] = planes.T
    d[0] = np.frombuffer(b, np.uint8, 8, 1)
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64)


def count_hashes(batches, partitions: int):
    """First pass, map side: the hashes of ``HELD`` phrases (about) by partition, sorted, with their counts."""
    lift = np.uint64(BITS - partitions.bit_length() + 1)

    def emit(held):
        h = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        h = h[first]
        cut = np.searchsorted(h, np.arange(partitions + 1, dtype=np.uint64) << lift)
        some = np.flatnonzero(np.diff(cut))
        counts = [n[cut[p]:cut[p + 1]].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in some]
        return pa.record_batch({
            "part": pa.array(some, pa.int64()), "mass": pa.array([int(n[cut[p]:cut[p + 1]].sum()) for p in some], pa.int64()),
            "hashes": pa.array([packed(h[cut[p]:cut[p + 1]]) for p in some], pa.binary()), "counts": pa.array(counts, pa.binary())})

    held, size = [], 0
    for batch in batches:
        for words, seed, _ in stretches(batch):
            for n in range(1, LONGEST + 1):
                held.append(short(words.hashes(words.phrases(n), n, seed)))
                size += len(held[-1])
            if size >= HELD:
                yield emit(held)
                held, size = [], 0
    if size:
        yield emit(held)


class Summary:
    """A mergeable Misra-Gries summary of weighted hashes: ``count`` is at most ``taken`` below the true count."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, h: np.ndarray, n: np.ndarray, taken: int = 0) -> None:
        h, n = np.concatenate((self.hash, h)), np.concatenate((self.count, n))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        self.hash, self.count = h[first], np.add.reduceat(n, first) if len(first) else n
        self.taken += taken
        if len(self.count) > self.capacity:
            least = int(np.partition(self.count, -self.capacity - 1)[-self.capacity - 1])
            stays = self.count > least
            self.hash, self.count = self.hash[stays], self.count[stays] - least
            self.taken += least


def survivors(group: pa.Table, threshold: int) -> pa.Table:
    """First pass, reduce side: the hashes of a partition that may occur ``threshold`` times."""
    part = group["part"][0].as_py()
    total = Summary(SPARE * (int(np.sum(group["mass"].to_numpy())) // threshold + 1))
    held, size = [], 0

    def fold():
        nonlocal held, size
        if held:
            total.merge(np.concatenate([h for h, _ in held]), np.concatenate([n for _, n in held]))
        held, size = [], 0

    for h, n in zip(group["hashes"], group["counts"]):
        h = unpacked(h.as_py())
        n = np.frombuffer(n.as_py(), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
        held.append((h, n))
        size += len(h)
        if size > total.capacity:
            fold()
    fold()
    found = total.hash[total.count + total.taken >= threshold]
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([len(found)], pa.int64()),
                     "hashes": pa.array([found.tobytes()], pa.binary())})


def bitmap(hashes: np.ndarray, low: int, high: int, shift: int) -> np.ndarray:
    """Bits, packed, of the places ``hash >> shift`` between ``low`` and ``high``."""
    bits = np.zeros(high - low, np.uint8)
    bits[(hashes >> np.uint64(shift)).astype(np.int64) - low] = 1
    return np.packbits(bits)


def count_phrases(batches, filters: np.ndarray, low: int, shift: int, words_too: bool):
    """Second pass, map side: counts of a stretch's phrases that the bitmap lets pass, and its words per language."""
    empty = pa.array([], pa.string())
    for batch in batches:
        for words, seed, names in stretches(batch):
            first, size, h, g = [], [], [], []
            for n in range(1, LONGEST + 1):
                at = words.phrases(n)
                k = words.hashes(at, n, seed)
                place = (short(k) >> np.uint64(shift)).astype(np.int64) - low
                inside = (place >= 0) & (place < 8 * len(filters))
                place = np.where(inside, place, 0)
                ok = inside & ((filters[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)
                first.append(at[ok])
                size.append(np.full(int(ok.sum()), n))
                h.append(k[ok])
                g.append(words.hashes(at[ok], n, seed, 1))
            first, size, h, g = (np.concatenate(x) for x in (first, size, h, g))
            order = np.argsort(h, kind="stable")
            if np.any((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])):  # two phrases share a hash
                order = np.lexsort((g, h))
            h, g = h[order], g[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(h)))
            one = order[new]
            text = words.strings(first[one], size[one]) if len(one) else empty
            spoken = np.bincount(words.language, minlength=len(names)) if words_too else np.zeros(len(names), np.int64)
            some = np.flatnonzero(spoken)
            yield pa.record_batch({
                "lang": names.take(pa.array(np.concatenate((words.language[first[one]], some)).astype(np.int64))).cast(pa.string()),
                "words": pa.array(np.concatenate((size[one], np.zeros(len(some)))).astype(np.int32)),
                "phrase": pa.concat_arrays([text, pa.nulls(len(some), pa.string())]),
                "f": pa.array(np.concatenate((n, spoken[some])).astype(np.int64))})


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, phrase, f for all phrases with f >= ``threshold``; a row with null phrase and 0 words gives a language's
    number of words. Counts are exact."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("language"), docs[text].cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 << max(0, (size // (MASS * 3 // 2)).bit_length())
    counted = rows.mapInArrow(lambda b: count_hashes(b, parts), "part long, mass long, hashes binary, counts binary")
    alive = materialize(counted.groupBy("part").applyInArrow(lambda t: survivors(t, threshold), "part long, n long, hashes binary"),
                        "survivors")
    left = alive.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = min(parts, 1 << max(0, (left - 1) // PER_ROUND).bit_length())
    bits = min(FILTER_BITS, max(16, (64 * left // rounds).bit_length(), (8 * parts // rounds - 1).bit_length()))
    shift = BITS - (rounds.bit_length() - 1) - bits
    each = (1 << bits) * rounds // parts  # places of a partition
    counts = []
    for r in range(rounds):
        whole = np.zeros(max(1, (1 << bits) // 8), np.uint8)
        mine = alive.filter((F.col("part") >= parts // rounds * r) & (F.col("part") < parts // rounds * (r + 1)) & (F.col("n") > 0))
        for row in mine.mapInArrow(lambda b: _places(b, each, shift), "part long, bits binary").toLocalIterator():
            at = (row["part"] - parts // rounds * r) * each // 8
            whole[at:at + each // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
        sent, low, first = spark.sparkContext.broadcast(whole), r << bits, r == 0
        found = rows.mapInArrow(lambda b, s=sent, low=low, first=first: count_phrases(b, s.value, low, shift, first),
                                "lang string, words int, phrase string, f long")
        found = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
        counts.append(materialize(found.filter((F.col("f") >= threshold) | (F.col("words") == 0)), "phrases"))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def _places(batches, each: int, shift: int):
    for b in batches:
        parts = b.column("part").to_pylist()
        bits = [bitmap(np.frombuffer(h.as_py(), np.uint64), p * each, (p + 1) * each, shift).tobytes()
                for p, h in zip(parts, b.column("hashes"))]
        yield pa.record_batch({"part": pa.array(parts, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate of ``frequent_phrases``, without those that longer ones cover."""
    w = F.split("phrase", " ")
    some = phrases.filter(F.col("words") >= 2).select("lang", "phrase", "words", F.col("f").alias("a"), w.alias("w"))
    parts = phrases.filter(F.col("words") >= 1).select("lang", "phrase", "f")
    cuts = some.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _part(F.col("w"), F.lit(1), F.col("k")))
    cuts = cuts.withColumn("rest", _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k"))).drop("w")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = f"cast(({FACTOR} * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)"
    least = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("c"))
    longer = some.filter(F.col("words") >= 3)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _part(F.col("w"), i, n))))
    cover = longer.select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    covered = F.expr(f"100 * cast(cover as decimal(20, 0)) >= {COVERED} * cast(a as decimal(20, 0))")
    kept = least.select("lang", "phrase", "c.*").join(cover, ["lang", "phrase"], "left").filter(F.col("cover").isNull() | ~covered)
    return kept.drop("cover", "k")


def top_phrases(docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` candidates by score and count, descending, then by phrase (bytes): lang, rank, phrase, a, l,
    r, n (the language's words), score."""
    phrases = frequent_phrases(docs, threshold, text, lang)
    total = phrases.filter(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    line = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(phrases).withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
