"""Token counts of whole texts under a public byte-level vocabulary, by rank-synchronous array merging (``bpe``).

Null texts count as empty (0 tokens). No begin, end or added tokens, no truncation; the string of a special token in a
text counts as that token, as the library does by default. Repeated rows give repeated rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from . import bpe
from .common import SLICE_BYTES, ship, slices, text_or_empty, utf8

LIMIT = 1024


def token_counts(path: str) -> Column:
    """A function column: number of tokens of a text under the vocabulary file ``path`` (the same on every machine)."""
    @arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        counter = bpe.shared(bpe.ByteCounter, path)
        _, off = utf8(texts)
        texts, out = texts.fill_null(""), []
        for i, j in slices(off, 4 * SLICE_BYTES):
            out += counter.counts(texts[i:j].to_pylist())
        return pa.array(out, pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    t = text_or_empty(docs, text)
    rows = docs.select(docs[key].alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"),
                       token_counts(path)(t).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
