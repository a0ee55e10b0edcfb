"""Shards by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnish.llm.common import staged, text_of

#: Slots are many more than shards, so moving one shifts little, and few enough for a driver.
SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, n_rows long, n_bytes long, first_place long"


def virtual_slot(id_column: Column, size: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record; depends on its id and text alone, never on the shards."""
    return F.pmod(F.xxhash64(id_column, size, crc), F.lit(slots)).cast("int")


def slot_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, place``: records, and their place inside a slot."""
    text = text_of(docs, text_col)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("size"), F.col("text_crc32"), slots))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return rows.withColumn("place", F.row_number().over(inside).cast("long") - 1)


def _totals(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, rows, bytes) of every slot in use; as many as there are slots, so the driver may hold them."""
    totals = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)), F.sum("size"))
    return sorted(tuple(r) for r in totals.collect())


def _version(spark: SparkSession, version: int, totals: list[tuple[int, int, int]], shard_of: dict[int, int]) -> DataFrame:
    filled: dict[int, int] = {}
    rows = []
    for slot, n, size in totals:
        shard = shard_of[slot]
        rows.append((version, slot, shard, n, size, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + n
    return staged(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1))


def first_map(rows: DataFrame, shards: int) -> DataFrame:
    """Version 1: the heaviest slot first, each to the shard that holds the fewest bytes."""
    totals = _totals(rows)
    heap = [(0, s) for s in range(shards)]
    shard_of = {}
    for slot, _, size in sorted(totals, key=lambda t: (-t[2], t[0])):
        held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return _version(rows.sparkSession, 1, totals, shard_of)


def rebalance(rows: DataFrame, slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for new rows or another number of shards.

    An edit: slots leave the fullest shard for the emptiest while that narrows the gap between
    them; all other slots stay where they are. Slots that are new, or whose shard is gone, count
    as unplaced and go to the emptiest shard first.
    """
    totals = _totals(rows)
    size_of = {slot: size for slot, _, size in totals}
    old = {r["virtual_slot"]: (r["version"], r["shard"]) for r in slot_map.select("version", "virtual_slot", "shard").collect()}
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    sums = [0] * shards
    loose = []
    for slot, size in size_of.items():
        shard = old.get(slot, (0, shards))[1]
        if shard < shards:
            held[shard][slot] = size
            sums[shard] += size
        else:
            loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-size_of[s], s)):
        shard = min(range(shards), key=lambda s: (sums[s], s))
        held[shard][slot] = size_of[slot]
        sums[shard] += size_of[slot]
    while True:
        high = max(range(shards), key=lambda s: (sums[s], -s))
        low = min(range(shards), key=lambda s: (sums[s], s))
        gap = sums[high] - sums[low]
        movable = [(abs(gap - 2 * size), slot) for slot, size in held[high].items() if size < gap]
        if not movable:
            break
        slot = min(movable)[1]
        size = held[high].pop(slot)
        held[low][slot] = size
        sums[high] -= size
        sums[low] += size
    shard_of = {slot: shard for shard, own in enumerate(held) for slot in own}
    version = 1 + max((v for v, _ in old.values()), default=0)
    return _version(rows.sparkSession, version, totals, shard_of)


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Every row with its shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    The law is ``bytes``: the UTF-8 sizes of the shards are near equal, as near as the heaviest
    slot allows. ``slot`` is the row's place in its shard, gapless from 0: the rows of the earlier
    slots of that shard, then the place inside the own slot, so no task ever sees a whole shard.

    Null text has size 1 and the checksum of empty text. Null ids are hashed by their text. Rows
    that agree in id and text share a slot; of each other they differ in ``slot`` only. An empty
    table gives an empty result. Other columns are not looked at.
    """
    rows = staged(slot_rows(docs, id_col, text_col, slots))
    # one row per slot: bounded by the number of slots, whatever the input
    where = F.broadcast(first_map(rows, shards).select("virtual_slot", "shard", "first_place", "version"))
    return rows.join(where, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_place") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
