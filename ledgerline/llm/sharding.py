"""Sharding through fixed virtual slots (DataFrame functions only).

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and a slot-to-shard
map (one row per slot, so its size is fixed) sends the slots to shards: largest slot first, each to
the lightest shard. The map is stored by version; rebalancing edits the map and moves whole slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.staging import delete_on_exit, shared_dir, stage

VIRTUAL_SLOTS = 4096
#: Parts in which the rows of one slot are numbered, so that a hot id is no single task.
PARTS = 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and virtual_slot of each row.

    The slot hashes the id; rows with a null id hash their size and checksum instead.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    return rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that is in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def _place(free: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """Give each free slot, the largest first, to the shard that is lightest by then.

    free: virtual_slot, bytes, n_rows. loads: shard, bytes already there. Both have at most one row
    per slot or shard, so the fold runs over a bounded array.
    """
    both = free.select("virtual_slot", "bytes", "n_rows", F.lit(None).cast("int").alias("shard")).unionByName(
        loads.select(F.lit(None).cast("int").alias("virtual_slot"), "bytes", F.lit(None).cast("long").alias("n_rows"), F.col("shard").cast("int").alias("shard"))
    )
    queue = both.agg(
        F.sort_array(F.collect_list(F.when(F.col("shard").isNull(), F.struct("bytes", "virtual_slot", "n_rows"))), asc=False).alias("queue"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("bytes"))), F.lit(0).cast("long")) for s in range(shards)]).alias("start"),
    )
    empty = F.expr("cast(array() as array<struct<virtual_slot:int,bytes:bigint,n_rows:bigint,shard:int>>)")

    def give(state, slot):
        to = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        return F.struct(
            F.transform(state["load"], lambda v, k: F.when(k == to, v + slot["bytes"]).otherwise(v)).alias("load"),
            F.concat(state["given"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), slot["bytes"].alias("bytes"), slot["n_rows"].alias("n_rows"), to.alias("shard")))).alias("given"),
        )

    placed = queue.select(F.aggregate("queue", F.struct(F.col("start").alias("load"), empty.alias("given")), give)["given"].alias("given"))
    return placed.select(F.inline("given"))


def initial_map(slots: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, bytes, n_rows, shard for a first placement."""
    none = slots.select(F.lit(0).alias("shard"), "bytes").limit(0)
    return _place(slots, none, shards)


def rebalance(current: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """Edit a map for new slot sizes or another number of shards, moving only what overfills a shard.

    Each shard keeps its slots, largest first, while they fit into an equal share of all bytes; slots
    beyond that, of shards that are gone, or new in use are placed anew.
    """
    now = slots.join(F.broadcast(current.select("virtual_slot", "shard")), "virtual_slot", "left")
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    judged = now.withColumn("share", F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(shards)).withColumn(
        "stays", F.coalesce((F.col("shard") < shards) & (F.sum("bytes").over(order) <= F.col("share")), F.lit(False))
    )
    kept = judged.filter("stays").select("virtual_slot", "bytes", "n_rows", F.col("shard").cast("int").alias("shard"))
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    return kept.unionByName(_place(judged.filter("not stays").select("virtual_slot", "bytes", "n_rows"), loads, shards))


def save_map(placed: DataFrame, root: str, version: int) -> DataFrame:
    """Store one version of a map under ``root`` and read it back; a version is written once only."""
    path = f"{root}/version={version:06d}"
    placed.coalesce(1).write.parquet(path)
    return placed.sparkSession.read.parquet(path)


def load_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version:06d}")


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = VIRTUAL_SLOTS, root: str | None = None) -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, next_shard.

    Law ``bytes``: shards get nearly equal sizes. ``slot`` is the row's place in its shard, without
    gaps from 0; grown_shard is null under this law. ``next_shard`` is the row's shard in the second
    version of the map, edited for one more shard. The maps are stored under ``root``, a folder of this call's
    own, which goes with the application, if none is given. Null texts have size 1 and checksum 0. Repeated
    rows get places of their own in the same shard. Null ids are spread by size and checksum. Empty
    tables give no rows, empty texts size 1; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, id_col, text_col, slots).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")), "sized")
    if root is None:
        root = f"{shared_dir(spark)}/ledgerline/slot-map-{uuid.uuid4().hex}"
        delete_on_exit(spark, root)
    slots_used = stage(slot_bytes(rows), "slots")
    placed = save_map(initial_map(slots_used, shards), root, 1)
    grown = save_map(rebalance(placed, slots_used, shards + 1), root, 2)
    maps = placed.select("virtual_slot", "shard").join(F.broadcast(grown.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")
    # At most PARTS rows for each slot, so the starts can be broadcast whatever the input.
    counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(maps), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "part", "shard", "next_shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "row")
    return (
        rows.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(starts), ["virtual_slot", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            "next_shard",
        )
    )
