"""Sharding by fixed virtual slots.

A record's key is hashed to one of some thousand slots, whose number never changes.
A versioned map says which shard holds a slot.  Growing or rebalancing edits the map
and so moves whole slots; no record is hashed anew.  The map has one row a slot, so
it is built and edited on the driver and stored as a table next to the shards.

Defined cases: a null key hashes like any other value (one slot); a null text has no
bytes and size 1; rows repeated in full get different positions in their shard; an
empty table gives an empty result and maps without bytes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import table

SLOTS = 4096
SHARDS = 16
#: Parts of a slot that are numbered apart, so a slot of equal keys is not one task.
PARTS = 16

SlotMap = list[int]


def first_map(n_shards: int = SHARDS, n_slots: int = SLOTS) -> SlotMap:
    """The shard of every slot before any edit."""
    return [slot % n_shards for slot in range(n_slots)]


def grown(slots: SlotMap, n_shards: int) -> SlotMap:
    """The map with one more shard, which takes its part of the slots from the fullest shards.

    It looks at slot numbers only, so key and number of shards decide where a record goes.
    """
    out = list(slots)
    owned: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    for slot, shard in enumerate(out):
        owned[shard].append(slot)
    for _ in range(len(out) // (n_shards + 1)):
        fullest = max(owned, key=lambda shard: (len(owned[shard]), -shard))
        out[owned[fullest].pop()] = n_shards
    return out


def rebalanced(slots: SlotMap, slot_bytes: dict[int, int], n_shards: int) -> SlotMap:
    """The map after moving slots from the heaviest to the lightest shard while that helps.

    Each step moves the largest slot that is smaller than the gap between both shards,
    so every move makes the pair more even and no slot moves twice between them.
    """
    out = list(slots)
    owned: dict[int, set[int]] = {shard: set() for shard in range(n_shards)}
    for slot, shard in enumerate(out):
        owned[shard].add(slot)
    load = {shard: sum(slot_bytes.get(s, 0) for s in owned[shard]) for shard in owned}
    for _ in range(4 * len(out)):
        heavy = max(load, key=lambda shard: (load[shard], -shard))
        light = min(load, key=lambda shard: (load[shard], shard))
        gap = load[heavy] - load[light]
        movable = [s for s in owned[heavy] if 0 < slot_bytes.get(s, 0) <= gap // 2]
        if not movable:
            break
        slot = max(movable, key=lambda s: (slot_bytes[s], -s))
        owned[heavy].remove(slot)
        owned[light].add(slot)
        load[heavy] -= slot_bytes[slot]
        load[light] += slot_bytes[slot]
        out[slot] = light
    return out


def map_table(spark: SparkSession, versions: Iterable[SlotMap]) -> DataFrame:
    """(version, vslot, shard), versions from 1; append new ones, never change old ones."""
    rows = [(v, s, shard) for v, m in enumerate(versions, 1) for s, shard in enumerate(m)]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def with_slot(df: DataFrame, key: str = "doc_id", n_slots: int = SLOTS) -> DataFrame:
    return df.withColumn("vslot", F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int"))


def records(docs: DataFrame) -> DataFrame:
    """One slim row a document: key, size in bytes, checksum, slot and part of the slot."""
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")
    return with_slot(slim).withColumn("part", part)


def assign(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """Every document's shard now, after growing by one, and after balancing bytes.

    ``slot`` numbers the rows of a shard without gaps: rows are numbered inside a part of
    a virtual slot, and the parts of a shard, a table of bounded size, are laid end to end.
    """
    spark = docs.sparkSession
    slim = written(records(docs), "slots")
    parts = slim.groupBy("vslot", "part").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes")
    )
    parts = written(parts, "slot-parts")
    per_slot = parts.groupBy("vslot").agg(F.sum("bytes").alias("slot_bytes"))
    slot_bytes = {r.vslot: r.slot_bytes for r in per_slot.collect()}  # at most n_slots rows
    first = first_map(n_shards, n_slots)
    maps = [first, grown(first, n_shards), rebalanced(first, slot_bytes, n_shards)]
    versions = written(map_table(spark, maps), "slot-map")

    def version(number: int, name: str) -> DataFrame:
        held = versions.filter(F.col("version") == number)
        return F.broadcast(held.select("vslot", F.col("shard").alias(name)))

    placed = (
        parts.join(version(1, "shard"), "vslot")
        .join(version(2, "grown_shard"), "vslot")
        .join(version(3, "balanced_shard"), "vslot")
        .join(F.broadcast(per_slot), "vslot")
    )
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = placed.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = Window.partitionBy("vslot", "part").orderBy("doc_id", "size", "text_crc32")
    # n_slots * PARTS rows at most
    return (
        slim.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(placed.drop("rows", "bytes")), ["vslot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
            "grown_shard", "vslot", "slot_bytes", "balanced_shard",
        )
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, folder: str) -> None:
    """The documents in one folder a shard, under the given version of the map.

    Columns named vslot or shard are replaced.
    """
    held = with_slot(docs.drop("vslot", "shard")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    held.drop("vslot").write.partitionBy("shard").mode("overwrite").parquet(folder)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
