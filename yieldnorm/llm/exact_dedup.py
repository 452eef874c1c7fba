"""Exact deduplication by a heavy-hitter split (DataFrame and SQL functions only).

1. Every text becomes a SHA-256 digest of its normalised form (A-Z lower-cased, null as empty).
2. A Misra-Gries summary (Spark's ``approx_top_k``, kept per task and merged) lists the digests that may hold
   more than about 1 / ``tracked`` of all rows; a second pass counts those exactly and finds their winners.
3. The verified winners, at most ``heavy`` rows, are broadcast: rows of heavy digests are settled where they are read.
4. The remaining digests, none of which has many rows, go through an ordinary shuffle.

Of equal texts the row with the largest doc_id stays (null is the smallest); of repeated rows with that doc_id
one stays. Null and empty texts are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.sizing import materialize
from .common import LOWER, UPPER, fresh, text_or_empty

#: Digests broadcast at most (each under 100 bytes) and counters of the summary.
HEAVY, TRACKED = 1000, 4096
#: Summaries are merged in so many groups first, so that no task merges those of all tasks.
MERGE_GROUPS = 64


def digest(df: DataFrame, text: str = "text") -> Column:
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(F.translate(text_or_empty(df, text), UPPER, LOWER).cast("binary"), 256)


def heavy_winners(rows: DataFrame, order: list[str], heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """digest, win (struct of ``order``), n: exact for each frequent digest of ``rows`` (digest, *order)."""
    part = rows.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("s"))
    # grouped by a value that is always 0: a global merge fails on partitions without rows
    listed = part.groupBy(F.col("g") % 1).agg(F.expr("approx_top_k_combine(s)").alias("s")).select(
        F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t")).select(F.col("t.item").alias("digest"))
    found = rows.join(F.broadcast(listed), "digest", "left_semi")
    return found.groupBy("digest").agg(F.max(F.struct(*order)).alias("win"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def mark_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", heavy: int = HEAVY,
                    tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Empty in, empty out."""
    rows = materialize(docs.select(docs[key].alias("doc_id"), digest(docs, text).alias("digest"))
                       .withColumn("row", F.monotonically_increasing_id()), "digests")
    win = materialize(heavy_winners(rows, ["doc_id", "row"], heavy, tracked), "heavy")
    settled = rows.join(F.broadcast(win), "digest").select(*rows.columns, "win", "n")
    rest = rows.join(F.broadcast(win.select("digest")), "digest", "left_anti")
    group = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("win"), F.count(F.lit(1)).alias("n"))
    rest = rest.join(group, "digest").select(*rows.columns, "win", "n")
    return settled.unionByName(rest).select(
        "doc_id", F.col("win.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("win.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", heavy: int = HEAVY,
                    tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows of heavy digests other than the winner's doc_id
    go where they are read; what is left of those digests (repeated rows) is reduced before the shuffle."""
    d, k, w, r = fresh(docs, "digest_", "key_", "win_", "rank_")
    rows = docs.select("*", digest(docs, text).alias(d), docs[key].alias(k))
    slim = materialize(rows.select(F.col(d).alias("digest"), F.col(k).alias("doc_id")), "digests")
    win = materialize(heavy_winners(slim, ["doc_id"], heavy, tracked), "heavy")
    win = F.broadcast(win.select(F.col("digest").alias(d), F.col("win.doc_id").alias(w)))
    light = rows.join(win, d, "left_anti")
    light = (light.withColumn(r, F.row_number().over(Window.partitionBy(d).orderBy(F.col(k).desc_nulls_last())))
             .filter(F.col(r) == 1).select(docs.columns))
    top = rows.join(win, d).filter(F.col(k).eqNullSafe(F.col(w)))
    top = (top.groupBy(d).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(r))
           .select(*[F.col(r)[c].alias(c) for c in docs.columns]))
    return light.unionByName(top)
