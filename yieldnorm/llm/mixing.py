"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words (runs other than ASCII white space; null text: 0). Each source's documents are permuted by a seeded
hash and laid end to end as a line of words. The source's target, in words, is taken from that line: whole passes,
then the first words of one more pass, cut into blocks of ``block_words``. A tree splits the exact block quotas of
all sources among the output shards: at each node the left half's quotas are drawn from the node's by the
multivariate hypergeometric law. Each source's blocks are permuted by an affine map; a shard takes the next disjoint
run of them as long as its quota. Within a shard, pieces are ordered by a hash (a local shuffle).

Targets: sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words; none gets more
than ``most`` times its size; the excess is shared again by weight. The taken words of a source equal its target,
rounded. No document is taken more than ``most`` times, and repeated rows are documents of their own. Null ids and
sources are ordinary values; empty texts have size 0 and nothing is taken of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType
from pyspark.sql.window import Window

from ..plans.sizing import materialize
from .common import give_back, ship, word_counts

WEIGHTS, MOST, BLOCK_WORDS, SHARD_BLOCKS, SEED = (5, 2, 1), 3, 4096, 2048, 17
#: Rows of a stretch of a source's line; positions are summed over stretches first, then within each.
STRETCH_ROWS = 4000
#: numpy's hypergeometric draws take fewer items than this.
DRAW_LIMIT = 10 ** 9
#: Sources whose totals may be gathered on the driver.
MAX_SOURCES = 100_000


@arrow_udf(LongType())
def words(texts: pa.Array) -> pa.Array:
    out = pa.array(word_counts(texts))
    give_back()
    return out


@dataclass
class Plan:
    """Per source: words, target, taken (rounded target), blocks, first rank of each shard; per tree: shards."""

    sources: list
    size: np.ndarray
    target: np.ndarray
    taken: np.ndarray
    blocks: np.ndarray
    step: np.ndarray
    shift: np.ndarray
    quota: np.ndarray  # (shards, sources)


def targets(size, weights, share: float = 1.0, most: float = MOST) -> np.ndarray:
    """Words wanted of each source: by weight, none above ``most`` times its size."""
    size, weights = np.asarray(size, float), np.asarray(weights, float)
    want, cap = share * size.sum(), most * size
    out, free = np.zeros(len(size)), np.ones(len(size), bool)
    while free.any():
        out[free] = max(0.0, want - out[~free].sum()) * weights[free] / weights[free].sum()
        over = free & (out > cap)
        if not over.any():
            break
        out[over] = cap[over]
        free &= ~over
    return out


def draw_good(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` items drawn without replacement are good: an exact hypergeometric draw of any size.

    numpy draws from fewer than ``DRAW_LIMIT`` items. From more, every item is first taken with chance n / all, by two
    binomial draws; whatever the chance, those taken are a uniform set of their number, so the few too many go, or the few
    still missing come, by a draw of the same kind with about the square root of n items.
    """
    total = good + bad
    if n <= 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if n > total // 2:
        return good - draw_good(good, bad, total - n, rng)
    if total < DRAW_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    if n <= 32:
        hits = 0
        for i in range(n):
            hits += int(rng.integers(total - i)) < good - hits
        return hits
    x, y = int(rng.binomial(good, n / total)), int(rng.binomial(bad, n / total))
    if x + y >= n:
        return x - draw_good(x, y, x + y - n, rng)
    return x + draw_good(good - x, bad - y, n - x - y, rng)


def split_quotas(quota: np.ndarray, capacity: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of exact block counts per shard: column sums are ``quota``, row sums ``capacity``."""
    if len(capacity) == 1:
        return quota[None, :]
    half = len(capacity) // 2
    n = int(capacity[:half].sum())
    left, rest, room = np.zeros_like(quota), int(quota.sum()), n
    for k, q in enumerate(quota):  # a multivariate draw, one source after another
        rest -= int(q)
        left[k] = draw_good(int(q), rest, room, rng)
        room -= int(left[k])
    return np.vstack([split_quotas(left, capacity[:half], rng), split_quotas(quota - left, capacity[half:], rng)])


def make_plan(sources: list, size, weights=WEIGHTS, share=1.0, most=MOST, block_words=BLOCK_WORDS,
              shard_blocks=SHARD_BLOCKS, seed=SEED) -> Plan:
    size = np.asarray(size, np.int64)
    w = [weights[i % len(weights)] for i in range(len(sources))]
    target = targets(size, w, share, most)
    taken = np.minimum(np.rint(target).astype(np.int64), np.int64(most) * size)
    blocks = -(-taken // block_words)
    total = int(blocks.sum())
    n = max(1, -(-total // shard_blocks))
    capacity = np.full(n, total // n) + (np.arange(n) < total % n)
    rng = np.random.default_rng(seed)
    quota = split_quotas(blocks, capacity, rng) if len(sources) else np.zeros((n, 0), np.int64)
    step, shift = np.ones(len(size), np.int64), np.zeros(len(size), np.int64)
    for k, b in enumerate(blocks):  # block -> (step * block + shift) mod blocks, a permutation
        if b > 1:
            s = int(b * 0.6180339887) | 1
            while math.gcd(s, int(b)) != 1:
                s += 1
            step[k], shift[k] = s % b, rng.integers(b)
    return Plan(list(sources), size, target, taken, blocks, step, shift, quota)


def source_totals(sized: DataFrame, max_sources: int = MAX_SOURCES) -> tuple[list, list, list]:
    """Sources by code point, null last, with their words and rows."""
    got = sized.groupBy("source").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).take(max_sources + 1)
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold their totals")
    got.sort(key=lambda r: (r.source is None, r.source or ""))
    return [r.source for r in got], [r.w for r in got], [r.n for r in got]


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = SEED,
          more: list[str] = ()) -> DataFrame:
    """doc_id, source, size and the hash that permutes a source's documents (and the columns ``more``)."""
    return docs.select(*more, docs[key].alias("doc_id"), docs[source].cast("string").alias("source"),
                       words(docs[text].cast("string")).alias("size"),
                       F.xxhash64(F.lit(seed), docs[key], docs[text].cast("string")).alias("h"))


def lines(sized: DataFrame, plan: Plan, counts: list, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``sized`` with its source's number and totals, and where the document begins on its source's line."""
    spark = sized.sparkSession
    table = spark.createDataFrame(
        [(s, k, int(plan.size[k]), float(plan.target[k]), int(plan.taken[k]), int(plan.blocks[k]), int(plan.step[k]),
          int(plan.shift[k]), max(1, -(-counts[k] // stretch_rows))) for k, s in enumerate(plan.sources)],
        "s string, source_no int, source_size long, target double, source_taken long, n_blocks long, step long, "
        "shift long, stretches long")
    # a stretch is a range of the hash: floor(h / 2**64 * stretches) for the hash read as unsigned
    part = F.floor((F.col("h").cast("double") / 2.0 ** 64 + 0.5) * F.col("stretches")).cast("long")
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("stretch", F.least(part, F.col("stretches") - 1))
    sums = rows.groupBy("source_no", "stretch").agg(F.sum("size").alias("w"))
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w")
    inside = (Window.partitionBy("source_no", "stretch").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(sums, ["source_no", "stretch"])
            .withColumn("begin", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("stretch", "stretches", "before"))


def pieces(block_words: int = BLOCK_WORDS, most: int = MOST) -> Column:
    """The pieces of a document that the mix takes: array of (pass, block, first, words), ``first`` counted in words of
    the document. Needs the columns of ``lines``."""
    def of_pass(e):
        lo = e * F.col("source_size") + F.col("begin")
        hi = F.least(lo + F.col("size"), F.col("source_taken"))
        b0, b1 = F.floor(lo / block_words), F.floor((hi - 1) / block_words)
        made = F.transform(F.sequence(b0, b1), lambda b: F.struct(
            e.alias("pass"), b.alias("block"), (F.greatest(lo, b * block_words) - lo).alias("first"),
            (F.least(hi, (b + 1) * block_words) - F.greatest(lo, b * block_words)).alias("words")))
        return F.when((hi > lo), made).otherwise(F.array().cast("array<struct<pass:bigint,block:bigint,first:bigint,words:bigint>>"))
    return F.flatten(F.transform(F.array(*[F.lit(i).cast("long") for i in range(int(math.ceil(most)))]), of_pass))


def shard_lookup(plan: Plan):
    """A function column: the output shard of each piece, from its block's rank in the source's permutation."""
    ends = np.cumsum(plan.quota, axis=0).T.copy()
    step, shift, blocks = plan.step, plan.shift, plan.blocks

    @arrow_udf(ArrayType(IntegerType()))
    def shards(block: pa.Array, source_no: pa.Array) -> pa.Array:
        n = np.asarray(block.value_lengths().fill_null(0))
        b = np.asarray(block.flatten(), np.int64)
        src = np.repeat(np.asarray(source_no), n)
        out = np.zeros(len(b), np.int32)
        for k in np.unique(src):
            at = src == k
            rank = [(int(x) * int(step[k]) + int(shift[k])) % int(blocks[k]) for x in b[at]]
            out[at] = np.searchsorted(ends[k], rank, "right")
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(out))

    return shards


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, text: str = "text", key: str = "doc_id",
        source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_no, source_size, target, source_taken, h, begin, pieces
    (what the mix takes of it) and shards (the output shard of each piece)."""
    ship(docs.sparkSession)
    sized = materialize(sizes(docs, text, key, source, seed), "sizes")
    names, size, counts = source_totals(sized)
    plan = make_plan(names, size, weights, share, most, block_words, shard_blocks, seed)
    out = lines(sized, plan, counts).withColumn("pieces", pieces(block_words, most))
    return out.withColumn("shards", shard_lookup(plan)(F.col("pieces.block"), F.col("source_no")))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, block_words: int = BLOCK_WORDS,
                  shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, text: str = "text", key: str = "doc_id",
                  source: str = "source") -> DataFrame:
    """The mix as rows of ``docs``, all their columns: documents stay whole, each as often as its pieces make up,
    rounded (only the last document of a source's line has a fraction). Rows lie in the order of a hash within a task,
    which holds stretches of many sources: the local shuffle."""
    ship(docs.sparkSession)
    sized = sizes(docs.withColumn("_doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), text, key, source, seed, ["_doc"])
    names, size, counts = source_totals(sized)
    plan = make_plan(names, size, weights, share, most, block_words, shard_blocks, seed)
    rows = lines(sized, plan, counts).withColumn("pieces", pieces(block_words, most))
    rows = rows.withColumn("shards", shard_lookup(plan)(F.col("pieces.block"), F.col("source_no")))
    times = F.round(taken() / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rows = rows.withColumn("times", times).filter("times > 0")
    rows = rows.select("_doc", F.posexplode(F.array_repeat(F.col("shards")[0], F.col("times"))).alias("copy", "shard"), "h")
    rows = rows.sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "copy", "h"))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def taken() -> Column:
    """Words the mix takes of a document, repeats counted, from its pieces."""
    return F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])


def deal(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, a row per piece: shard, place (a hash that orders the shard: the local shuffle), doc_id, source,
    pass, block, first, words, and source_no and begin, which name a row that has words, be it repeated or not."""
    z = mixed.select("*", F.explode(F.arrays_zip("pieces", "shards")).alias("z"))
    p = F.col("z.pieces")
    return z.select(F.col("z.shards").alias("shard"),
                    F.xxhash64(F.lit(seed), "source_no", p["pass"], p["block"], "h", p["first"]).alias("place"), "doc_id",
                    "source", p["pass"].alias("pass"), p["block"].alias("block"), p["first"].alias("first"),
                    p["words"].alias("words"), "source_no", "begin")


def dealt(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST, block_words: int = BLOCK_WORDS,
          shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, text: str = "text", key: str = "doc_id",
          source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix as it is dealt to the shards, and what each document has in it. The first is ``deal`` as a table, written
    in the order of shard and place, so that a shard is a run of its files. The second is summed from that table, one
    row per row of ``docs``: doc_id, source, size, source_size, target, taken, n_pieces, shards (the shard of each
    piece, in the order of pass and block)."""
    mixed = materialize(mix(docs, weights, share, most, block_words, shard_blocks, seed, text, key, source), "mixed")
    out = materialize(deal(mixed, seed).orderBy("shard", "place"), "mix")
    held = F.sort_array(F.collect_list(F.struct("pass", "block", "shard")))
    sums = out.groupBy("source_no", "begin").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).cast("int").alias("n_pieces"),
                                                 F.transform(held, lambda x: x["shard"]).alias("shards"))
    rows = mixed.select("source_no", "begin", "doc_id", "source", "size", "source_size", "target")
    some = rows.filter("size > 0").join(sums, ["source_no", "begin"], "left")  # rows without words begin where others do
    nothing = {"taken": F.lit(0).cast("long"), "n_pieces": F.lit(0), "shards": F.array().cast("array<int>")}
    none = rows.filter("size = 0").withColumns(nothing)
    whole = some.withColumns({c: F.coalesce(c, v) for c, v in nothing.items()}).unionByName(none)
    return out, whole.drop("source_no", "begin")
