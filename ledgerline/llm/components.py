"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.skew import split_join
from ledgerline.llm.staging import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (columns a, b: long).

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the smaller ones
    (Kiveris et al., 2014). Minima are grouped with map-side combining; the centres of large stars get theirs
    by ``split_join``, so no node's neighbours meet in one task. Rounds are written to the shared folder.
    Loops, repeated edges and empty tables are allowed.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = split_join(both.filter("v > u"), lowest, "u", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, lowest, "u", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lowest.select("u", F.col("m").alias("v")))
        now = stage(small.distinct(), "small")
        before, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
