"""Samples of a table that both sides of a comparison can repeat."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.hashing import hash_bucket


def sample_size(n: int, ratio: float, cap: int = 1000) -> int:
    """n times ratio, but at least 1 and at most cap."""
    return max(1, min(cap, int(n * ratio)))


def sample_window(df: DataFrame, ratio: float, order_by: list[str], seed: int = 0, cap: int = 1000, offset: int | None = None) -> DataFrame:
    """A contiguous window of rows in an order, from a seeded offset or from the one given."""
    n = df.count()
    size = sample_size(n, ratio, cap)
    if offset is None:
        offset = random.Random(seed).randint(0, max(0, n - size))
    return df.orderBy(*order_by).offset(offset).limit(size)


def sample_keys(df: DataFrame, keys: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """Rows whose hashed key falls below the ratio: spread over the table, and the same keys on every side.

    The hash is the MD5 of the key's texts and the seed, joined by U+001F, so that other systems can repeat it.
    """
    steps = 1_000_000
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys], F.lit(str(seed)))
    return df.filter(hash_bucket(F.md5(text), steps) < int(ratio * steps))


def head_ordered(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows in an order; each task keeps n."""
    return df.orderBy(*order_by).limit(n)


def page(df: DataFrame, order_by: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in an order."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def first_per_group(df: DataFrame, group: list[str], order_by: list[str], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per group before the exchange."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
