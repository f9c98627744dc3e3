"""Joins that stay even when a few keys hold most of the rows, and broadcasts that are bound in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.skew import PARTS, split_join

__all__ = ["BROADCAST_BYTES", "PARTS", "SALTS", "salted_join", "small", "split_join", "stored_bytes"]

#: Bytes of a stored table up to which it is broadcast whole.
BROADCAST_BYTES = 16 << 20
#: Keys that rows of one key are dealt over where a lookup is too large for that.
SALTS = 16


def stored_bytes(table: DataFrame) -> int:
    """Size of a stored table's files, as Spark's statistics have it."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(table: DataFrame) -> DataFrame:
    """``table``, which is stored, marked for broadcasting if its files are small enough; else it is left to a shuffle."""
    return F.broadcast(table) if stored_bytes(table) <= BROADCAST_BYTES else table


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the stored ``lookup``, which has each key once: broadcast if its files are small enough.

    Else the rows of a key are dealt over SALTS keys by the partition they come from, each with a row of the lookup.
    """
    if stored_bytes(lookup) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup), key, how)
    dealt = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
