"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots for good.  Bytes and rows are aggregated per
slot, and a small versioned table maps slots to shards.  Rebalancing edits the newest version: the
slots of shards above the mean move to shards below it, the largest first, then single slots are
exchanged while that brings two shards nearer.  Records never move but with their slot, and a
record is found by one hash and one look-up.  Records without id are never looked up; their place decides,
so that a table a third of which is null rows still has near equal shards.  Records equal in id
and text share a slot.  The map has ``SLOTS`` rows at any size of the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import stored
from palimpsest.session import work_path

SLOTS = 8192
SHARDS = 24
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by id and text; null for a null id, by which no record is looked up."""
    return F.when(doc_id.isNotNull(), F.pmod(F.xxhash64(doc_id, text), F.lit(slots))).cast("int")


def spread_nameless(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Gives records without id the slot of their place in the stored table, so that any number of equal ones spread."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    place = F.pmod(F.xxhash64(part, "_metadata.row_index"), F.lit(slots)).cast("int")
    return rows.withColumn("vslot", F.coalesce("vslot", place))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every row; null text counts as no bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("vslot"),
    )


def slot_loads(rows: DataFrame) -> DataFrame:
    """``vslot, bytes, rows``: one row per used slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rebalanced(owner: list[int], loads: list[int], shards: int) -> list[int]:
    """A map (shard of every slot) with near equal loads, edited from ``owner``.

    New shards start empty; slots of shards that no longer exist are dealt again.
    """
    slots, total = list(owner), sum(loads)
    held: list[list[int]] = [[] for _ in range(shards)]
    pool: list[int] = []
    for s, shard in enumerate(slots):
        (held[shard] if shard < shards else pool).append(s)
    sums = [sum(loads[s] for s in h) for h in held]
    mean = total / shards
    for shard in range(shards):
        # Small slots leave first; the last to leave takes the shard below the mean.
        held[shard].sort(key=lambda s: (-loads[s], s))
        while held[shard] and sums[shard] > mean:
            s = held[shard].pop()
            sums[shard] -= loads[s]
            pool.append(s)
    heap = [(sums[i], i) for i in range(shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-loads[s], s)):
        low, shard = heapq.heappop(heap)
        slots[s] = shard
        held[shard].append(s)
        sums[shard] = low + loads[s]
        heapq.heappush(heap, (sums[shard], shard))
    for _ in range(10 * shards):
        high, low = max(range(shards), key=lambda i: (sums[i], -i)), min(range(shards), key=lambda i: (sums[i], i))
        if not _exchange(slots, held, sums, loads, high, low):
            break
    return slots


def _exchange(slots: list[int], held: list[list[int]], sums: list[int], loads: list[int], high: int, low: int) -> bool:
    """Move a slot from the fullest to the emptiest shard, or exchange two, nearest to half the gap."""
    gap = sums[high] - sums[low]
    back = sorted([(0, -1)] + [(loads[s], s) for s in held[low]])
    best = None
    j = 0
    for s in sorted(held[high], key=lambda s: (loads[s], s)):
        while j + 1 < len(back) and abs(loads[s] - back[j + 1][0] - gap / 2) <= abs(loads[s] - back[j][0] - gap / 2):
            j += 1
        for load, t in back[max(0, j - 1) : j + 2]:
            change = loads[s] - load
            if 0 < change < gap and (best is None or abs(change - gap / 2) < best[0]):
                best = abs(change - gap / 2), s, t
    if best is None:
        return False
    _, s, t = best
    for k, a, b in ((s, high, low), (t, low, high)):
        if k >= 0:
            held[a].remove(k)
            held[b].append(k)
            slots[k] = b
            sums[a] -= loads[k]
            sums[b] += loads[k]
    return True


def save_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Add a version of the map to the table at ``path``."""
    rows = [(version, s, shard) for s, shard in enumerate(owner)]
    spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest version and its map."""
    table = spark.read.schema("version int, vslot int, shard int").parquet(path)
    newest = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == newest).collect()
    return newest, [r["shard"] for r in sorted(rows, key=lambda r: r["vslot"])]


def rebalance(spark: SparkSession, path: str, loads: DataFrame, shards: int, slots: int = SLOTS) -> int:
    """Write the next version of the map for ``slot_loads``; its number.  Collects ``slots`` rows at most."""
    version, owner = load_map(spark, path)
    known = {r["vslot"]: r["bytes"] for r in loads.collect()}
    save_map(spark, path, version + 1, rebalanced(owner, [known.get(s, 0) for s in range(slots)], shards))
    return version + 1


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version`` of every row.

    Law ``bytes``: the shards' sizes are near equal, as near as whole slots allow.  ``slot`` is the
    row's place in its shard, gapless from 0: slots of a shard stand in the order of their numbers,
    rows of a slot in that of id, checksum and size (null ids first).  Rows that are equal in all
    get places in any order.  ``path`` names the map table; by default a new one under the shared
    folder, whose version 0 deals the slots in turn.
    """
    spark = docs.sparkSession
    rows = spread_nameless(stored(records(docs, slots), "shard-records"), slots)
    loads = stored(slot_loads(rows), "slot-loads")
    if path is None:
        path = work_path(spark, "slot-map")
        save_map(spark, path, 0, [s % shards for s in range(slots)])
    version = rebalance(spark, path, loads, shards, slots)
    owner = spark.read.schema("version int, vslot int, shard int").parquet(path).where(F.col("version") == version)
    # One row per slot, a fixed number: a window over a shard's slots and a broadcast are both bounded.
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = owner.join(loads, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("base")
    )
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(base), "vslot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "vslot", F.lit(version).alias("map_version"),
    )
