"""Connected components by alternating large-star and small-star steps.

The links stay distributed; each round is written to the shared checkpoint folder, and only a count and a checksum
reach the driver. A node with many links is reduced map-side (minimum per node); the joins may split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import materialize

MAX_ROUNDS = 50


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join reads it through a shuffle of its own and a node with many links can be split
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b: long); loops and repeats don't matter."""
    e = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        e = materialize(_small_star(_large_star(e).distinct()).distinct(), "stars")
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
