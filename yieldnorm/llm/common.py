"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy passes hold at once, with several 8-byte temporaries per byte.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch in jobs whose workers serve many stages.
BATCH_BYTES = 4 << 20
#: Upper-case ASCII and its lower-case form; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Multipliers of a byte by its place in its word; places beyond the table use it again.
_POW = np.cumprod(np.full(1 << 12, 0x100000001B3, np.uint64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows go to Python workers in batches of at most ``most`` bytes, unless the session names a limit of its own: an
    executor holds each batch twice, in its own buffers and in the worker's."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Free memory that a worker's allocators keep goes back to the system: the next stage's worker, or the executor, may
    need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed, where they clash with a column of ``df`` in any case, until they don't."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def remainder(col: Column, by: int) -> Column:
    """crc32 of the value as text, modulo ``by``; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % by


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal numbers stay equal, close numbers come apart."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (with the end of the last);
    a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_string()).fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """(first, end) row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes that are not ASCII white space); rows end words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off[:-1]] = True
    cut = cut[:-1]
    start = np.flatnonzero(inside & np.concatenate(([True], cut[1:] | ~inside[:-1])))
    end = np.flatnonzero(inside & np.concatenate((cut[1:] | ~inside[1:], [True]))) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    b = (data[np.repeat(start, n) + place].astype(np.uint64) + np.uint64(1)) * _POW[place & (len(_POW) - 1)]
    return mix64(np.add.reduceat(b, first) + n.astype(np.uint64))


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    data, off = utf8(texts)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in slices(off):
        lo, hi = off[i], off[j]
        _, _, row = word_bounds(data[lo:hi], off[i:j + 1] - lo)
        out[i:j] = np.bincount(row, minlength=j - i)
    return out


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers that don't share the driver's module path."""
    sc = spark.sparkContext
    if "yieldnorm_llm.zip" in sc._python_includes:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="yieldnorm-")) / "yieldnorm_llm.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
