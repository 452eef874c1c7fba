"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands); bytes and rows are summed per slot; a small,
versioned slot-to-shard map, stored as a table, says which shard holds a slot. Rebalancing edits the map: it moves
slots from shards above the mean to those below and writes the next version; records never need hashing anew.

Size is the text's UTF-8 bytes plus ``OVERHEAD`` (null text: only that). A null doc_id hashes with the text. A
record's slot depends on doc_id and text, and for a repeated row on its number among its equals, so that these spread
over the slots; which of them has which number makes no difference. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.sizing import list_names, materialize, path_exists, scratch_path

SLOTS, SHARDS, OVERHEAD = 8192, 24, 8
#: Equal rows are numbered within so many groups, then from group to group.
GROUPS = 1024


def records(docs: DataFrame, n_slots: int = SLOTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot for each row."""
    t = F.coalesce(docs[text].cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(t).alias("text_crc32"), F.xxhash64(docs[key], t).alias("h"),
                       (F.monotonically_increasing_id() % GROUPS).cast("int").alias("g"))
    rows = materialize(rows, "records")  # a row keeps its group
    equal = ["h", "size", "text_crc32"]
    counts = rows.groupBy(*equal, "g").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*equal).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    # a group before which there are none, as of rows without equals, needs no entry
    counts = counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").drop("n")
    inside = F.row_number().over(Window.partitionBy(*equal, "g").orderBy("doc_id")) - 1
    rows = rows.withColumn("k", inside).join(materialize(counts, "repeated"), [*equal, "g"], "left")
    k = F.col("k") + F.coalesce("before", F.lit(0))
    slot = F.pmod(F.when(k == 0, F.col("h")).otherwise(F.xxhash64("h", k)), F.lit(n_slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def first_map(n_slots: int = SLOTS, n_shards: int = SHARDS) -> np.ndarray:
    """Version 0: slots dealt out in turn."""
    return np.arange(n_slots, dtype=np.int64) % n_shards


def rebalance(shard_of: np.ndarray, load: np.ndarray, n_shards: int) -> np.ndarray:
    """The map edited until shard loads are near equal. Each shard keeps its largest slots that fit under the level and
    hands on the others, which go, largest first, to the shard with the least load. The level is the mean, without the
    slots that are larger and the shards that these fill alone."""
    out = shard_of.copy()
    order = np.lexsort((np.arange(len(load)), -load))
    rest, left = float(load.sum()), n_shards
    for s in order:
        if left == 1 or load[s] * left <= rest:
            break
        rest, left = rest - load[s], left - 1
    level = rest / left
    total, moving = np.zeros(n_shards), []
    for s in order:
        own = out[s]
        if load[s] > level and (own >= n_shards or total[own] > 0):
            own = out[s] = int(np.argmin(total))  # a shard that still has nothing, as the largest come first
        if own < n_shards and (total[own] + load[s] <= level or load[s] == 0 or total[own] == 0):
            total[own] += load[s]
        else:
            moving.append(s)
    least = [(total[k], k) for k in range(n_shards)]
    heapq.heapify(least)
    for s in moving:
        at, k = heapq.heappop(least)
        out[s] = k
        heapq.heappush(least, (at + load[s], k))
    return out


def _cut_off(spark: SparkSession, path: str) -> bool:
    """A version folder whose write did not end."""
    return path_exists(spark, path) and not path_exists(spark, f"{path}/_SUCCESS")


def save_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Writes version ``version`` of the map (slot, shard) below ``path``."""
    rows = [(int(i), int(s)) for i, s in enumerate(shard_of)]
    (spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1)
     .write.mode("overwrite" if _cut_off(spark, f"{path}/version={version}") else "error").parquet(f"{path}/version={version}"))


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The last version of the map below ``path`` that was written whole; None if there is none."""
    found = [int(n.split("=", 1)[1]) for n in list_names(spark, path)
             if n.startswith("version=") and path_exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(found, default=None)


def newest_map(spark: SparkSession, path: str, n_slots: int) -> np.ndarray | None:
    """Shard of each slot in the newest version, if there is one. A map of another number of slots raises: records
    would need hashing anew."""
    version = newest_version(spark, path)
    if version is None:
        return None
    rows = load_map(spark, path, version).collect()  # a row per virtual slot
    out = np.full(n_slots, -1, np.int64)
    if len(rows) != n_slots or any(not 0 <= r.virtual_slot < n_slots for r in rows):
        raise ValueError(f"the map at {path} has {len(rows)} slots, not {n_slots}")
    for r in rows:
        out[r.virtual_slot] = r.shard
    return out


def shard(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, map_path: str | None = None,
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards ``docs`` so that bytes per shard are near equal: doc_id, size, text_crc32, shard, slot (the place in the
    shard, gapless from 0), virtual_slot, map_version. What reaches the driver has one row per virtual slot.

    ``map_path`` keeps the map between calls: the newest version there is edited for the bytes of these ``docs`` and
    ``n_shards`` and written as the next one, so that most slots stay where they are; the first call deals the slots out
    in turn as version 0 and writes its edit as version 1. Without ``map_path`` the map is a scratch table."""
    spark = docs.sparkSession
    rows = materialize(records(docs, n_slots, text, key), "sharded")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    load, count = np.zeros(n_slots), np.zeros(n_slots, np.int64)
    for r in sums:
        load[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.n
    path = map_path or scratch_path(spark, "slot-map")
    shard_of = newest_map(spark, path, n_slots)
    if shard_of is None:
        shard_of = first_map(n_slots, n_shards)
        save_map(spark, path, 0, shard_of)
    version = newest_version(spark, path) + 1
    shard_of = rebalance(shard_of, load, n_shards)
    save_map(spark, path, version, shard_of)
    first = np.zeros(n_slots, np.int64)
    for k in range(n_shards):
        own = np.flatnonzero(shard_of == k)
        first[own] = np.cumsum(count[own]) - count[own]
    starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(first)], "virtual_slot int, first long")
    placed = load_map(spark, path, version).join(F.broadcast(starts), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col("doc_id"), "size", "text_crc32"))
    return (rows.join(F.broadcast(placed), "virtual_slot").withColumn("place", place)
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"),
                    "virtual_slot", F.lit(version).alias("map_version")))
