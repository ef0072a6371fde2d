"""Sharding over fixed virtual slots.

A record's key is hashed into one of a fixed number of slots; the slot never changes.  The bytes of each slot are summed
in one aggregation, and a table (version, slot, shard) says where the slots live.  Rebalancing and growing edit that
table, a few thousand rows whatever the input, and store it as a new version; records follow their slot.

The law held by `shard_documents` is `bytes`: shards hold nearly equal numbers of bytes.  A slot stays whole, so shards
differ by about the size of the last slot dealt.

Nulls: a null text has 1 byte and the checksum of an empty one; a null doc_id is hashed with its text.  Repeated rows
share a slot and get places of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.session import scratch_path

SLOTS = 4096
SHARDS = 16


def slot_of(key: Column, *more: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record."""
    return F.pmod(F.xxhash64(key, *more), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, rows) of every slot, empty ones included; `records` has slot and size."""
    found = records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(found, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def initial_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn, before any size is known."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(current: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version: slots from the largest to the smallest, each to the shard with the fewest bytes so far.

    Among equally filled shards the slot stays where it was.  All slots, a fixed number, are folded in one row.
    """
    ordered = loads.join(current.select("slot", "shard"), "slot").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "slot", "shard"))).alias("todo"),
    )
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
                     F.array().cast("array<int>").alias("to"))

    def place(acc, x):
        least = F.array_min(acc["loads"])
        here = F.when(F.get(acc["loads"], x["shard"]) == least, x["shard"]).otherwise(
            F.array_position(acc["loads"], least).cast("int") - 1)
        return F.transform(F.array(F.struct(here.alias("s"))), lambda c: F.struct(
            F.transform(acc["loads"], lambda b, i: F.when(i == c["s"], b - x["less"]).otherwise(b)).alias("loads"),
            F.concat(acc["to"], F.array(c["s"])).alias("to")))[0]

    folded = ordered.select("todo", F.aggregate("todo", start, place, lambda acc: acc["to"]).alias("to"))
    moved = folded.select(F.explode(F.arrays_zip("todo", "to")).alias("m")).select("m.todo.slot", "m.to")
    return moved.join(current.agg((F.max("version") + 1).alias("version")), F.lit(True)).select(
        "version", "slot", F.col("to").cast("int").alias("shard"))


def grow(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, which takes slots from every old one; no slot moves between old ones."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64("slot"), "slot")
    total = Window.partitionBy("shard")
    filled = current.join(loads.select("slot", "bytes"), "slot").withColumns({
        "upto": F.sum("bytes").over(w), "whole": F.sum("bytes").over(total), "version": F.col("version") + 1})
    return filled.select("version", "slot", F.when(
        F.col("upto") * (shards + 1) <= F.col("whole"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


class SlotMaps:
    """The versions of a slot-to-shard map below one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, rows: DataFrame) -> None:
        rows.select("slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}").select(
            F.lit(version).alias("version"), "slot", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (the place in the shard, from 0) of every document.

    Only these narrow columns are shuffled, once, by virtual slot.  Places count inside a slot and start behind the
    slots before it in the shard, so no task sees a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        slot_of(F.col("doc_id"), F.when(F.col("doc_id").isNull(), text), slots=slots).alias("slot")), "records")
    loads = stored(slot_bytes(records, slots), "loads")
    maps = SlotMaps(spark, scratch_path(spark, "slot-maps"))
    maps.store(0, initial_map(spark, shards, slots))
    maps.store(1, rebalance(maps.load(0), loads, shards))
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    homes = maps.load(1).join(loads, "slot").select(
        F.col("slot").alias("virtual_slot"), "shard",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(homes, placed["slot"] == homes["virtual_slot"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")
