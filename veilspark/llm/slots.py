"""Sharding by fixed virtual slots (DataFrame functions only).

Each record hashes into one of thousands of slots for good; a small versioned table says which shard holds a slot.
Bytes are aggregated for each slot, and rebalancing edits the table: it moves slots, never single records, so a
new version says exactly which slots change hands. A table that is stored from an earlier run goes on from its newest
version, and gets a new one only if shards have grown too unequal or their number has changed. The law is ``bytes``: shards hold nearly the same number of bytes.

The slot hash (32 bits of an MD5, which other engines have as well) takes doc_id and the text's CRC, so rows without an id and rows that repeat an id spread as well.
Equal texts of different ids are separate records and spread over slots like any others: a group of copies that holds a
third of all rows is no hot slot. Rows that repeat both id and text are in one slot. A null text has no bytes (size 1, CRC 0). Empty tables give an empty result and a table of empty slots.
The slot table has a fixed number of rows (``n_slots``), whatever the data; only it is broadcast or folded in one row.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

N_SLOTS = 4096


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text)
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32")).withColumn(
        "virtual_slot", (F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32")), 1, 8), 16, 10).cast("long") % n_slots).cast("int")
    )


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for all slots, empty ones included."""
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return (
        rows.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
        .join(F.broadcast(held), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])
    )


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of a slot table: slots dealt out in turn."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a slot table: from the largest slot down, a slot stays where it is while its shard keeps to
    an even share of all bytes; otherwise it goes to the shard that holds least so far. Few slots move, and shards end
    within about one small slot of each other. ``n_shards`` may exceed the present number (then the new ones fill up)."""
    joined = slot_map.join(F.broadcast(sizes), "virtual_slot")
    one = joined.groupBy().agg(
        F.max("version").alias("version"), F.ceil(F.sum("bytes") / F.lit(n_shards)).alias("share"),
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("slots"),
    )

    def place(state, x):
        stays = (x["shard"] < n_shards) & (F.get(state["load"], x["shard"]) + x["bytes"] <= state["share"])
        to = F.when(stays, x["shard"]).otherwise((F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int"))
        return F.struct(
            state["share"].alias("share"),
            F.transform(state["load"], lambda v, i: F.when(i == to, v + x["bytes"]).otherwise(v)).alias("load"),
            F.array_append(state["done"], F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard"))).alias("done"),
        )

    start = F.struct(
        F.col("share").cast("long").alias("share"), F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("done"),
    )
    return one.select((F.col("version") + 1).alias("version"), F.explode(F.aggregate("slots", start, place)["done"]).alias("x")).select("version", "x.virtual_slot", "x.shard")


def save_version(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored table; earlier versions stay readable."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    table = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slots that change hands between two versions: virtual_slot, from_shard, to_shard."""
    both = old.select("virtual_slot", F.col("shard").alias("from_shard")).join(new.select("virtual_slot", F.col("shard").alias("to_shard")), "virtual_slot")
    return both.where("from_shard <> to_shard")


def balanced(slot_map: DataFrame, sizes: DataFrame, n_shards: int, slack: float) -> bool:
    """Whether all shards are below ``n_shards`` and none holds more than an even share of all bytes and ``slack`` of it."""
    loads = slot_map.join(F.broadcast(sizes), "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    most = loads.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("whole"), F.max("shard").alias("last")).first()
    return most["last"] < n_shards and most["most"] <= most["whole"] / n_shards * (1 + slack)


def advance(spark: SparkSession, path: str, sizes: DataFrame, n_shards: int, n_slots: int, slack: float) -> DataFrame:
    """The version of the stored table that holds for ``sizes``: the newest, or one more. A table that isn't there yet
    begins with slots dealt in turn."""
    try:
        stored = load_version(spark, path)
    except AnalysisException:
        save_version(first_map(spark, n_shards, n_slots), path)
        save_version(rebalance(load_version(spark, path), sizes, n_shards), path)
        return load_version(spark, path)
    if stored.count() != n_slots:
        raise ValueError(f"the stored table hasn't {n_slots} slots; records keep their slots for good")
    if balanced(stored, sizes, n_shards, slack):
        return stored
    save_version(rebalance(stored, sizes, n_shards), path)
    return load_version(spark, path)


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None, slack: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, version, shard, slot (place in the shard, gapless from 0) of every row.

    ``map_path``: where the slot table is stored between runs (None: a table of this run alone, which begins with slots
    dealt in turn and is rebalanced once on the bytes measured). A row's place is the number of rows in earlier slots of
    its shard plus its rank within its virtual slot, so no shard is sorted as one.
    """
    spark = docs.sparkSession
    rows = materialise(slotted(docs, n_slots), "slotted")
    sizes = materialise(slot_sizes(rows, n_slots), "slot-sizes")
    newest = advance(spark, map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}", sizes, n_shards, n_slots, slack)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    known = newest.join(F.broadcast(sizes.select("virtual_slot", "rows")), "virtual_slot")
    placed = known.select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "version", "shard", (F.col("ahead") + F.col("rank") - 1).cast("long").alias("slot")
    )
