"""Digests of key ranges, compared down a tree.

Borders are keys of the source, one in every so many rows. They are stored once and hold for both sides, so a row that only one side
has changes the range it lies in and no other. Ranges are the leaves of a tree whose nodes are runs of ``fan_out`` ranges, runs of runs, and
so on. Each level digests the rows of the nodes that differ, by one grouping of both sides that combines before the exchange; what is equal is
not looked at again. Rows find their range by binary search over the borders of their node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.hashing import hash_halves
from ledgerline.operators.chunks import position_chunks
from ledgerline.operators.digests import hash_sums, hashed
from ledgerline.operators.skew import salted_join
from ledgerline.session import stored

FAN_OUT = 256
SUMS = ("n", "s1", "s2", "s3")


def key_borders(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """chunk and key (a struct): the key at every position chunk * chunk_rows but the first, in key order, NULL before all else.

    Keys may be of any types that can be ordered. A key on which several borders fall has the last one's number. Only the keys are
    shuffled and stored.
    """
    placed = position_chunks(df.select(*keys), keys, chunk_rows)
    cuts = placed.filter((F.col("position") > 0) & (F.col("position") % chunk_rows == 0))
    return stored(cuts.groupBy(F.struct(*keys).alias("key")).agg(F.max("chunk").alias("chunk")).select("chunk", "key"))


def borders_until(borders: Column, key: Column, most: int) -> Column:
    """How many of at most ``most`` sorted borders a key is not below, by binary search."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]

    def step(found: Column, ahead: Column) -> Column:
        return F.when(F.get(borders, found + ahead - 1) <= key, found + ahead).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _children(nodes: DataFrame, borders: DataFrame, width: int, fan_out: int) -> DataFrame:
    """node, keys and ids: the borders between the children of each node, at most fan_out of them, in order."""
    child = F.floor(F.col("chunk") / width).cast("bigint")
    first = borders.groupBy(child.alias("child")).agg(F.min("key").alias("key"))
    listed = first.groupBy(F.floor(F.col("child") / fan_out).cast("bigint").alias("node")).agg(F.array_sort(F.collect_list(F.struct("key", "child"))).alias("list"))
    listed = nodes.select("node").join(listed, "node", "left")
    return stored(listed.select("node", F.transform("list", lambda x: x["key"]).alias("keys"), F.transform("list", lambda x: x["child"]).alias("ids")))


def _descended(rows: DataFrame, children: DataFrame, fan_out: int) -> DataFrame:
    """Rows of the nodes with children, each under its child; below the first border lies child 0, which is in node 0."""
    found = salted_join(rows, children, "node").withColumn("_at", borders_until(F.col("keys"), F.col("key"), fan_out))
    return found.select("key", "h", "side", F.coalesce(F.get("ids", F.col("_at") - 1), F.lit(0).cast("bigint")).alias("node"))


def _compared(rows: DataFrame) -> DataFrame:
    """node, and count and sums of either side's hashes there; ``differs`` if they are not equal."""
    sums = rows.select("node", "side", *hash_halves("h")).groupBy("node", "side").agg(*hash_sums(F.col("hi"), F.col("lo")))
    zero = F.lit(0).cast("decimal(38,0)")
    picked = [F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))).cast("decimal(38,0)"), zero).alias(f"{side}_{c}") for side in ("source", "target") for c in SUMS]
    both = sums.groupBy("node").agg(*picked)
    same = F.lit(True)
    for c in SUMS:
        same = same & (F.col(f"source_{c}") == F.col(f"target_{c}"))
    counts = [F.col(f"{side}_n").cast("bigint").alias(f"{side}_rows") for side in ("source", "target")]
    return stored(both.select("node", *counts, (~same).alias("differs")))


def range_checksum_diff(source: DataFrame, target: DataFrame, keys: list[str], chunk_rows: int = 50_000, fan_out: int = FAN_OUT, **options) -> DataFrame:
    """chunk, source_rows, target_rows and lo (the range's first key as a struct, NULL for the first range) for each key range whose rows differ.

    Ranges hold chunk_rows rows of the source each, but for repeats of a key, which are in one. Target columns are told without regard to case, and
    target keys take the types of the source's. Empty tables are equal.
    """
    there = {c.lower(): c for c in target.columns}
    renamed = target.select(*[F.col(f"`{there[k.lower()]}`").cast(source.schema[k].dataType).alias(k) for k in keys], *[c for c in target.columns if c.lower() not in {k.lower() for k in keys}])
    borders = key_borders(source, keys, chunk_rows)
    sides = [hashed(a, other=b, keep=tuple(keys), **options).select(F.struct(*keys).alias("key"), "h", F.lit(name).alias("side")) for a, b, name in ((source, renamed, "source"), (renamed, source, "target"))]
    rows = sides[0].unionByName(sides[1]).withColumn("node", F.lit(0).cast("bigint"))
    last = borders.agg(F.max("chunk")).first()[0] or 0
    depth = 1
    while fan_out**depth <= last:
        depth += 1
    nodes = source.sparkSession.range(1).select(F.col("id").alias("node"))
    for level in range(depth - 1, -1, -1):
        rows = _descended(rows, _children(nodes, borders, fan_out**level, fan_out), fan_out)
        nodes = _compared(rows).filter("differs")
        if nodes.isEmpty():
            break
    lo = borders.select(F.col("chunk").alias("node"), F.col("key").alias("lo"))
    return nodes.join(lo, "node", "left").select(F.col("node").alias("chunk"), "source_rows", "target_rows", "lo")
