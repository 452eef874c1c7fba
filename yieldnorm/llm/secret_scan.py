"""Secret scan: three fixed patterns, and a token-efficiency test for random strings.

Patterns, leftmost non-overlapping each: ``assign`` (a key word, a colon or equals sign, a value of 6 or more
characters), ``access`` (AKIA and capitals or digits, 20 or more in all), ``hex`` (24 or more lower-case hex digits).
The method adds ``random``: a run of at least ``MIN_RUN`` letters, digits and ``+/_=-`` whose characters per token,
under a public tiktoken vocabulary, number at most ``MAX_RATIO``; ordinary words and names take fewer tokens. Known
digests (hex of a digest's length), UUIDs and numbers are left out by their form, and so is a run that overlaps a span
of the patterns. A run of parts of one letter case each is measured in lower case, as names in capitals take more tokens.

Null texts count as empty: no spans. Positions are code points, the end exclusive. Whole texts are read.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import SLICE_BYTES, ship, slices, text_or_empty, utf8

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")  # a run that is long enough is matched whole
KINDS = ("assign", "access", "hex", "random")

MIN_RUN, MAX_RATIO = 20, 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST_DIGITS = (32, 40, 48, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMBER = re.compile(r"[0-9]+(?:[-_/+=][0-9]+)*[-_/+=]*")
_WORDS = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=](?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType())]))
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def known(run: str) -> bool:
    """A digest, a UUID, or a number (or several, joined): not a random string."""
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    bare = run.strip("+/_=-")
    return len(bare) in DIGEST_DIGITS and _HEX.fullmatch(bare) is not None


def ratio(run: str, enc: tiktoken.Encoding) -> float:
    """Characters per token."""
    return len(run) / len(enc.encode_ordinary(run.lower() if _WORDS.fullmatch(run) else run))


def spans(text: str, enc: tiktoken.Encoding) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m["value"]) >= ASSIGN_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    k = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][1] <= a:
            k += 1
        if k < len(base) and base[k][0] < b or known(m[0]):
            continue
        if ratio(m[0], enc) <= MAX_RATIO:
            found.append(("random", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(path: str) -> Column:
    """A function column: the spans of a text, by start and kind; ``path`` names the tiktoken vocabulary."""
    @arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        _, off = utf8(texts)
        texts = texts.fill_null("")
        ends, kind, start, end = [0], [], [], []
        for i, j in slices(off, 4 * SLICE_BYTES):
            for t in texts[i:j].to_pylist():
                for k, a, b in spans(t, enc):
                    kind.append(k)
                    start.append(a)
                    end.append(b)
                ends.append(len(kind))
        cols = [pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, ["kind", "start", "end"]))

    return find


def find_secrets(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end)."""
    ship(docs.sparkSession)
    return docs.select(docs[key].alias("doc_id"), scan(path)(text_or_empty(docs, text)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(found: str, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(found, lambda s: s["kind"] == kind)
