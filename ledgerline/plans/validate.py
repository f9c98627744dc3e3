"""Validation modes: each compares a source with a target table and reports one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import compare
from ledgerline.operators.ranges import range_checksum_diff
from ledgerline.operators.sampling import sample_keys, sample_size
from ledgerline.sources.tables import estimate_rows, estimate_rows_by_statistics

#: Defaults: share of rows sampled, buckets, rows up to which unkeyed tables are compared row by row, rows of a chunk.
RATIO, BUCKETS, GROUP_ROWS, CHUNK_ROWS = 0.01, 100, 1_000_000, 50_000


def _report(counts: DataFrame, table: str, mode: str, diff: Column, suggestion: str) -> DataFrame:
    """counts: one row with source_rows, target_rows and what ``diff`` needs."""
    rows = counts.withColumn("diff_rows", diff.cast("bigint"))
    bad = (F.col("diff_rows") != 0) | (F.col("source_rows") != F.col("target_rows"))
    return rows.select(
        F.lit(table).alias("table_name"),
        F.lit(mode).alias("mode"),
        F.when(bad, "fail").otherwise("pass").alias("status"),
        "source_rows",
        "target_rows",
        "diff_rows",
        F.lit(None).cast("string").alias("error"),
        F.when(bad, suggestion).alias("suggestion"),
    )


def _counts(source: DataFrame, target: DataFrame) -> DataFrame:
    return compare.row_counts({"t": source}, {"t": target}).select("source_rows", "target_rows", F.lit(1).alias("one"))


def validate_counts(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """Exact row counts; diff_rows is source minus target."""
    return _report(_counts(source, target), table, "quick", F.col("source_rows") - F.col("target_rows"), "row counts differ: compare by hash")


def validate_estimates(source: DataFrame, target: DataFrame, table: str, tolerance: float = 0.0, statistics: bool = False) -> DataFrame:
    """Row counts that need no scan; differences up to the tolerance only warn.

    They are those of the files' footers, or with ``statistics`` what Spark's statistics say.
    """
    count = estimate_rows_by_statistics if statistics else estimate_rows
    a, b = count(source), count(target)
    both = a.select(F.col("n_rows").alias("source_rows"), F.lit(1).alias("one")).join(b.select(F.col("n_rows").alias("target_rows"), F.lit(1).alias("one")), "one")
    out = _report(both, table, "quick-estimate", F.col("source_rows") - F.col("target_rows"), "estimates differ: count exactly")
    near = F.abs("diff_rows") <= tolerance * F.greatest("source_rows", "target_rows")
    return out.withColumn("status", F.when((F.col("status") == "fail") & near, "warn").otherwise(F.col("status")))


def validate_hash_group(source: DataFrame, target: DataFrame, table: str, **options) -> DataFrame:
    """All rows of both sides, as multisets of row hashes; diff_rows is the larger one-sided surplus."""
    return _hash_group_report(compare.hash_totals(source, target, **options), table)


def _hash_group_report(totals: DataFrame, table: str) -> DataFrame:
    return _report(totals.withColumnRenamed("diff_rows", "d"), table, "hash_group", F.col("d"), "list the differing hashes")


def validate_digest(source: DataFrame, target: DataFrame, table: str, **options) -> DataFrame:
    """Yes or no from the tables' digests; diff_rows is 1 where they differ."""
    both = compare.tables_equal(source, target, **options)
    return _report(both, table, "aggregate", F.when(F.col("equal"), 0).otherwise(1), "compare by hash groups to find the rows")


def validate_buckets(source: DataFrame, target: DataFrame, table: str, buckets: int = BUCKETS, **options) -> DataFrame:
    """Hash buckets whose multisets differ; diff_rows sums their surpluses."""
    by_bucket = compare.bucket_counts(source, target, buckets, **options)
    totals = by_bucket.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_rows", "target_rows")], F.coalesce(F.sum("diff_rows"), F.lit(0)).alias("d"))
    return _report(totals, table, "bucket", F.col("d"), "list the differing buckets")


def validate_checksum(source: DataFrame, target: DataFrame, table: str, keys: list[str] | None = None, chunk_rows: int = CHUNK_ROWS, **options) -> DataFrame:
    """Digests of chunks in key order; diff_rows is the number of chunks that differ. Without keys, hash groups."""
    if not keys:
        return validate_hash_group(source, target, table, **options)
    return _checksum_report(compare.chunk_checksums(source, target, keys, chunk_rows, **options), table)


def _checksum_report(chunks: DataFrame, table: str) -> DataFrame:
    totals = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_rows", "target_rows")], F.count_if("differs").alias("d"))
    return _report(totals, table, "checksum", F.col("d"), "compare the differing chunks by column")


def validate_ranges(source: DataFrame, target: DataFrame, table: str, keys: list[str] | None = None, chunk_rows: int = CHUNK_ROWS, **options) -> DataFrame:
    """Digests of key ranges of the source; diff_rows is the number of ranges that differ, so rows that one side lacks count where they lie. Without keys, hash groups."""
    if not keys:
        return validate_hash_group(source, target, table, **options)
    diff = range_checksum_diff(source, target, keys, chunk_rows, **options).agg(F.count(F.lit(1)).alias("d"), F.lit(1).alias("one"))
    return _report(_counts(source, target).join(diff, "one"), table, "ranges", F.col("d"), "compare the differing ranges by column")


def validate_sample(source: DataFrame, target: DataFrame, table: str, keys: list[str] | None = None, ratio: float = RATIO, seed: int = 0, order_by: list[str] | None = None, **options) -> DataFrame:
    """Counts, then a sample: by hashed key where there is one, else by position in an order.

    diff_rows counts sampled source rows without an equal target row. Rows that only the target has are
    found by the counts alone.
    """
    if keys:
        sampled = sample_keys(source, keys, ratio, seed)
        there = compare.lookup_keys(target, sampled, keys)
        diff = compare.hash_group_diff(sampled, there, **options)
        diff = diff.agg(F.coalesce(F.sum(F.greatest(F.col("source_n") - F.col("target_n"), F.lit(0))), F.lit(0)).alias("d"), F.lit(1).alias("one"))
    else:
        order = order_by or compare.common_columns(source, target)
        n = sample_size(source.count(), ratio)
        diff = compare.positional_diff(source, target, order, n).agg(F.count_distinct("position").alias("d"), F.lit(1).alias("one"))
    return _report(_counts(source, target).join(diff, "one"), table, "sample", F.col("d"), "compare the sampled rows by column")


def validate_light(source: DataFrame, target: DataFrame, table: str, order_by: list[str], n: int = 100) -> DataFrame:
    """Counts, then the first n rows by light texts; diff_rows counts differing positions."""
    diff = compare.positional_diff(source, target, order_by, n).agg(F.count_distinct("position").alias("d"), F.lit(1).alias("one"))
    both = _counts(source, target).join(diff, "one")
    equal = F.col("source_rows") == F.col("target_rows")
    return _report(both, table, "light", F.when(equal, F.col("d")).otherwise(F.col("source_rows") - F.col("target_rows")), "compare by hash")


def validate_full(source: DataFrame, target: DataFrame, table: str, keys: list[str] | None = None, chunk_rows: int = CHUNK_ROWS, **options) -> DataFrame:
    """Counts, hash groups and, with keys, chunk checksums together; the largest difference counts.

    Counts come with the hash groups, whose surplus is never less than their difference. With keys, rows are hashed once for both.
    """
    if keys:
        totals, chunks = compare.totals_and_checksums(source, target, keys, chunk_rows, **options)
        parts = _hash_group_report(totals, table).unionByName(_checksum_report(chunks, table))
    else:
        parts = validate_hash_group(source, target, table, **options)
    worst = F.max(F.struct((F.col("status") == "fail").alias("bad"), F.abs("diff_rows").alias("size"), F.struct("*").alias("row")))
    return parts.groupBy("table_name").agg(worst.alias("w")).select("table_name", F.lit("full").alias("mode"), *[f"w.row.{c}" for c in ("status", "source_rows", "target_rows", "diff_rows", "error", "suggestion")])


def choose_strategy(n_rows: int, keys: list[str] | None = None, limit: int = GROUP_ROWS) -> str:
    """sample for keyed tables; else hash_group up to the limit, and aggregate beyond it."""
    if keys:
        return "sample"
    return "hash_group" if n_rows <= limit else "aggregate"


def validate_auto(source: DataFrame, target: DataFrame, table: str, keys: list[str] | None = None, **options) -> DataFrame:
    mode = choose_strategy(0 if keys else source.count(), keys)
    return validate_sample(source, target, table, keys, **options) if mode == "sample" else MODES[mode](source, target, table, **options)


MODES = {
    "quick": validate_counts,
    "quick-estimate": validate_estimates,
    "sample": validate_sample,
    "hash_group": validate_hash_group,
    "aggregate": validate_digest,
    "bucket": validate_buckets,
    "auto": validate_auto,
    "checksum": validate_checksum,
    "ranges": validate_ranges,
    "light": validate_light,
    "full": validate_full,
}


def validate(pairs: dict[str, tuple[DataFrame, DataFrame]], mode: str = "sample", keys: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """The reports of many tables in one mode. An unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known are {', '.join(MODES)}")
    out = None
    for table, (source, target) in pairs.items():
        extra = {"keys": (keys or {}).get(table)} if mode in ("sample", "checksum", "ranges", "auto", "full") else {}
        if mode == "light":
            extra = {"order_by": (keys or {}).get(table) or compare.common_columns(source, target)}
        one = MODES[mode](source, target, table, **extra, **options)
        out = one if out is None else out.unionByName(one)
    return out
