"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record belongs to one of a fixed number of slots by the hash of its id.  Bytes
are added up per slot, and a small map says which shard a slot is in.  Making
shards even, or adding one, edits the map and gives it a new version; slots that
the edit leaves alone keep their shard.  Only DataFrame functions touch records.

Edge cases: a null text has no bytes but its record still has the overhead; a
null id is hashed like any other value; rows that are the same throughout are
separate records with places of their own; an empty table gives an empty table.
Columns of the input other than id and text are not read, so their names cannot
clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from runweave.llm.common import bucket_of
from runweave.storage import cut_lineage

SLOTS = 4096
# A slot with more than a shard's share over this is edited into parts.
SPLIT_SHARE = 16
PARTS = 64
OVERHEAD = 16
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("vslot", T.IntegerType(), False),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
    ]
)
Unit = tuple[int, int]


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, row_id, sub`` of every record, written once."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        bucket_of(slots, "doc_id").alias("vslot"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return cut_lineage(rows, "shard-rows").withColumn("sub", bucket_of(PARTS, "row_id"))


def slot_loads(rows: DataFrame, shards: int) -> dict[Unit, int]:
    """Bytes per slot; a slot over its bound comes in parts (``part`` from 0), all
    others whole (part -1).  At most ``SLOTS`` whole slots and
    ``shards * SPLIT_SHARE * PARTS`` parts reach the driver."""
    per_sub = cut_lineage(rows.groupBy("vslot", "sub").agg(F.sum("size").alias("bytes")), "shard-loads")
    per_slot = {r.vslot: r.bytes for r in per_sub.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}
    bound = sum(per_slot.values()) / (shards * SPLIT_SHARE)
    hot = [slot for slot, size in per_slot.items() if size > bound]
    loads = {(slot, -1): size for slot, size in per_slot.items() if size <= bound}
    if hot:
        for r in per_sub.where(F.col("vslot").isin(hot)).collect():
            loads[r.vslot, r["sub"]] = r.bytes
    return loads


def first_map(loads: dict[Unit, int], shards: int) -> dict[Unit, int]:
    """Version 1: slots in turn over the shards, parts of a slot over neighbours."""
    return {unit: (unit[0] + max(unit[1], 0)) % shards for unit in loads}


def add_shard(placed: dict[Unit, int], loads: dict[Unit, int], shards: int) -> dict[Unit, int]:
    """Edit a map of ``shards`` shards so that one more takes its share of each
    shard's slots; no slot moves but into it."""
    placed, total = dict(placed), sum(loads.values())
    share = total / (shards + 1)
    held: dict[int, list[Unit]] = {s: [] for s in range(shards)}
    for unit, shard in sorted(placed.items()):
        held[shard].append(unit)
    for units in held.values():
        over = sum(loads[u] for u in units) - share
        # The largest that fit first, so that what is left over is small.
        for unit in sorted(units, key=lambda u: (-loads[u], u)):
            if loads[unit] <= over:
                over -= loads[unit]
                placed[unit] = shards
    return placed


def rebalance(placed: dict[Unit, int], loads: dict[Unit, int], shards: int) -> dict[Unit, int]:
    """Edit a map until no move of a slot from the fullest shard to the emptiest
    narrows the gap between them."""
    placed = dict(placed)
    held: dict[int, list[Unit]] = {s: [] for s in range(shards)}
    for unit, shard in placed.items():
        held[shard].append(unit)
    total = {s: sum(loads[u] for u in units) for s, units in held.items()}
    fullest = [(-size, s) for s, size in total.items()]
    emptiest = [(size, s) for s, size in total.items()]
    heapq.heapify(fullest)
    heapq.heapify(emptiest)
    while fullest:
        size, source = fullest[0][0] * -1, fullest[0][1]
        if size != total[source]:
            heapq.heapreplace(fullest, (-total[source], source))
            continue
        while emptiest[0][0] != total[emptiest[0][1]]:
            heapq.heapreplace(emptiest, (total[emptiest[0][1]], emptiest[0][1]))
        target = emptiest[0][1]
        gap = size - total[target]
        movable = [u for u in held[source] if loads[u] < gap]
        if not movable:
            break
        unit = min(movable, key=lambda u: (abs(2 * loads[u] - gap), u))
        held[source].remove(unit)
        held[target].append(unit)
        total[source] -= loads[unit]
        total[target] += loads[unit]
        placed[unit] = target
        heapq.heapreplace(fullest, (-total[source], source))
        heapq.heappush(fullest, (-total[target], target))
        heapq.heapreplace(emptiest, (total[target], target))
        heapq.heappush(emptiest, (total[source], source))
    return placed


def store_map(spark: SparkSession, versions: list[dict[Unit, int]], loads: dict[Unit, int]) -> DataFrame:
    """All versions of a map as one table in the shared folder."""
    rows = [
        (v, slot, part, shard, loads[slot, part])
        for v, placed in enumerate(versions, 1)
        for (slot, part), shard in sorted(placed.items())
    ]
    return cut_lineage(spark.createDataFrame(rows, MAP_SCHEMA), "shard-map")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``part`` and ``shard`` from one version of a map.  A map has at most
    slots + shards * SPLIT_SHARE * PARTS rows, so it is broadcast."""
    whole = slot_map.where("part = -1").select("vslot", F.col("shard").alias("_whole"))
    parts = slot_map.where("part >= 0").select("vslot", F.col("part").alias("sub"), F.col("shard").alias("_part"))
    return (
        rows.join(F.broadcast(whole), "vslot", "left")
        .join(F.broadcast(parts), ["vslot", "sub"], "left")
        .withColumn("shard", F.coalesce("_whole", "_part"))
        .drop("_whole", "_part")
    )


def numbered(placed: DataFrame) -> DataFrame:
    """Add ``slot``: the place of a record in its shard, from 0 without gaps.

    Rows are numbered within small cells (slot, part, piece of the input), and
    cells start where the cells before them in their shard end, so no task sees
    a whole shard or a whole hot slot.
    """
    cells = placed.withColumn("_piece", F.shiftright("row_id", 33).cast("int"))
    cell = ["shard", "vslot", "sub", "_piece"]
    counts = cells.groupBy(cell).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("shard", "vslot").orderBy("sub", "_piece")
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    slots = counts.groupBy("shard", "vslot").agg(F.sum("_n").alias("_rows"))
    over = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_slot_at", F.coalesce(F.sum("_rows").over(over), F.lit(0))).drop("_rows")
    starts = counts.join(slots, ["shard", "vslot"]).select(*cell, (F.col("_in_slot") + F.col("_slot_at")).alias("_at"))
    inside = Window.partitionBy(cell).orderBy("row_id")
    return (
        cells.withColumn("_rank", F.row_number().over(inside))
        .join(starts, cell)
        .withColumn("slot", (F.col("_at") + F.col("_rank") - 1).cast("long"))
        .drop("_piece", "_at", "_rank")
    )


def shard_by_bytes(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Every record with its shard and place, and the stored map.

    Version 1 deals slots out in turn, version 2 is its edit by measured bytes.
    """
    rows = measured(docs, slots)
    loads = slot_loads(rows, shards)
    first = first_map(loads, shards)
    slot_map = store_map(docs.sparkSession, [first, rebalance(first, loads, shards)], loads)
    return numbered(assign(rows, slot_map.where("version = 2"))), slot_map
