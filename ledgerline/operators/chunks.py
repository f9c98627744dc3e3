"""Chunks of a table: by ranges of an integer key, and by position in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import stored


def range_chunks(df: DataFrame, pk: str, chunk_rows: int) -> DataFrame:
    """chunk, lo, hi, is_last: ranges [lo, hi) of equal width over an integer key; the last one has no end.

    An empty table, or one whose keys are all null, has no chunks.
    """
    ends = df.agg(F.min(pk).cast("long").alias("low"), F.max(pk).cast("long").alias("high"), F.count(F.lit(1)).alias("n_rows")).filter("low IS NOT NULL")
    ends = ends.withColumn("chunks", F.greatest(F.ceil(F.col("n_rows") / chunk_rows), F.lit(1)).cast("long"))
    ends = ends.withColumn("width", F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / F.col("chunks")), F.lit(1)).cast("long"))
    parts = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    parts = parts.filter("low + chunk * width <= high").withColumn("is_last", F.expr("low + (chunk + 1) * width > high"))
    return parts.select("chunk", F.expr("low + chunk * width").alias("lo"), F.when(~F.col("is_last"), F.expr("low + (chunk + 1) * width")).alias("hi"), "is_last")


def assign_chunk(df: DataFrame, pk: str, chunk_rows: int) -> DataFrame:
    """``df`` with the chunk of ``range_chunks`` that each row is in; null keys go into the last chunk."""
    low, high, n = df.agg(F.min(pk).cast("long"), F.max(pk).cast("long"), F.count(F.lit(1))).first()
    if low is None:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    count = max(1, -(-n // chunk_rows))
    width = max(1, -(-(high - low + 1) // count))
    last = (high - low) // width
    return df.withColumn("chunk", F.coalesce(F.floor((F.col(pk).cast("long") - F.lit(low)) / F.lit(width)), F.lit(last)).cast("long"))


def position_chunks(df: DataFrame, order_by: list[Column | str], chunk_rows: int) -> DataFrame:
    """``df`` with ``position`` (0, 1, ... in the order given) and ``chunk`` (position div chunk_rows).

    Rows are range-partitioned and numbered within their partition; the partitions' counts, one row each,
    give the offsets. No task sees more than its own range. The numbered rows are stored before they are
    counted: ranges are cut by a sample, and planned twice they would be cut in two ways.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = rows.join(F.broadcast(bases), "_part").withColumn("position", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return placed.withColumn("chunk", F.floor(F.col("position") / chunk_rows)).select(*df.columns, "position", "chunk")


def row_chunks(df: DataFrame, order_by: list[str], chunk_rows: int) -> DataFrame:
    """chunk, n_rows and the first and last position of each chunk; together they hold every row once."""
    return (
        position_chunks(df.select(*order_by), order_by, chunk_rows)
        .groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("position").alias("first"), F.max("position").alias("last"))
    )


def read_jdbc_partitioned(spark: SparkSession, url: str, table: str, pk: str, chunk_rows: int, properties: dict | None = None) -> DataFrame:
    """A table read over JDBC in ranges of an integer key, one partition for each chunk.

    ``pk`` is written as the database needs it, with quotes if its name has lower-case letters there.
    """
    ends = spark.read.jdbc(url, f"(SELECT MIN({pk}) AS lo, MAX({pk}) AS hi, COUNT(*) AS n FROM {table}) ends", properties=properties or {}).first()
    if ends[0] is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, column=pk, lowerBound=int(ends[0]), upperBound=int(ends[1]) + 1, numPartitions=max(1, -(-int(ends[2]) // chunk_rows)), properties=properties or {})
