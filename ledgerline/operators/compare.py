"""Differences between a source and a target table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.canonical import canonical_light
from ledgerline.functions.hashing import half_bucket, halves_hash, hash_halves
from ledgerline.operators.digests import bucket_digests, chunk_sums, hashed, placed_hashes, sums_line, table_digest
from ledgerline.session import shuffles_deleted


def common_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Source names of the columns on both sides, without regard to case, in order."""
    there = {c.lower() for c in target.columns}
    return sorted(c for c in source.columns if c.lower() in there)


def _aligned(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = common_columns(source, target)
    other = {c.lower(): c for c in target.columns}
    return source.select(*names), target.select(*[target[other[c.lower()]].alias(c) for c in names])


def row_counts(source_by: dict[str, DataFrame], target_by: dict[str, DataFrame]) -> DataFrame:
    """table_name, source_rows, target_rows, diff_rows for every table on either side; a missing table has null rows."""
    def counts(by: dict[str, DataFrame], column: str) -> DataFrame:
        parts = [df.agg(F.count(F.lit(1)).alias(column)).select(F.lit(name).alias("table_name"), column) for name, df in by.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    both = counts(source_by, "source_rows").join(counts(target_by, "target_rows"), "table_name", "full_outer")
    return both.withColumn("diff_rows", F.coalesce("source_rows", F.lit(0)) - F.coalesce("target_rows", F.lit(0)))


def hash_group_diff(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """h, source_n, target_n for each row hash whose counts differ.

    One shuffle: both sides are tagged and counted in one grouping, so equal rows meet once and are
    combined before the exchange.
    """
    return hash_group_counts(source, target, **options).filter("source_n <> target_n")


def hash_group_counts(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """h, source_n, target_n for each row hash of either side."""
    return _half_counts(source, target, **options).select(halves_hash().alias("h"), "source_n", "target_n")


def _half_counts(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``hash_group_counts`` by the halves hi and lo of the hash."""
    return _counted(*[hashed(x, other=y, **options).select(*hash_halves("h")) for x, y in ((source, target), (target, source))])


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """hi, lo, source_n, target_n of the halves of both sides' hashes."""
    both = a.select("hi", "lo", F.lit(1).alias("d")).unionByName(b.select("hi", "lo", F.lit(-1).alias("d")))
    return both.groupBy("hi", "lo").agg(F.count_if(F.col("d") == 1).alias("source_n"), F.count_if(F.col("d") == -1).alias("target_n"))


def surplus() -> Column:
    """The larger one-sided surplus, as an aggregate over source_n and target_n."""
    more, less = F.greatest(F.col("source_n") - F.col("target_n"), F.lit(0)), F.greatest(F.col("target_n") - F.col("source_n"), F.lit(0))
    return F.coalesce(F.greatest(F.sum(more), F.sum(less)), F.lit(0))


def hash_totals(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """One row, source_rows, target_rows, diff_rows (see ``surplus``): both sides are read once."""
    return _totals(_half_counts(source, target, **options))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.coalesce(F.sum(f"{side}_n"), F.lit(0)).alias(f"{side}_rows") for side in ("source", "target")], surplus().alias("diff_rows"))


def missing_rows(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of the source that the target lacks: by key, or as multisets over the common columns."""
    if keys:
        return source.join(target.select(*keys), keys, "left_anti")
    a, b = _aligned(source, target)
    return a.exceptAll(b)


def extra_rows(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of the target that the source lacks."""
    if keys:
        return target.join(source.select(*keys), keys, "left_anti")
    a, b = _aligned(source, target)
    return b.exceptAll(a)


def column_diff(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys, column_name, source_value, target_value for every value that differs between rows of one key; NULL equals NULL."""
    a, b = _aligned(source, target)
    low = {k.lower() for k in keys}
    names = [c for c in a.columns if c.lower() not in low and (columns is None or c in columns)]
    b = b.select(*keys, *[F.col(c).alias(f"_target_{c}") for c in names])
    cells = F.array(
        *[
            F.when(
                ~F.col(c).eqNullSafe(F.col(f"_target_{c}")),
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("source_value"), F.col(f"_target_{c}").cast("string").alias("target_value")),
            )
            for c in names
        ]
    )
    return a.join(b, keys).select(*keys, F.explode(F.array_compact(cells)).alias("d")).select(*keys, "d.*")


def positional_diff(source: DataFrame, target: DataFrame, order_by: list[str], n: int = 1000) -> DataFrame:
    """position, column_name, source_value, target_value over the first n rows of both sides in one order, by light texts."""
    a, b = _aligned(source, target)

    def first(df: DataFrame, side: str) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order_by))
        rows = df.orderBy(*order_by).limit(n).withColumn("position", place)
        return rows.select("position", *[canonical_light(c).alias(f"{side}_{c}") for c in df.columns])

    both = first(a, "s").join(first(b, "t"), "position", "full_outer")
    cells = F.array(
        *[
            F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), F.struct(F.lit(c).alias("column_name"), F.col(f"s_{c}").alias("source_value"), F.col(f"t_{c}").alias("target_value")))
            for c in a.columns
        ]
    )
    return both.select("position", F.explode(F.array_compact(cells)).alias("d")).select("position", "d.*")


def _both(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    a = a.select(on, F.col("n_rows").alias("source_rows"), F.col("digest").alias("source_digest"))
    b = b.select(on, F.col("n_rows").alias("target_rows"), F.col("digest").alias("target_digest"))
    both = a.join(b, on, "full_outer").fillna(0, ["source_rows", "target_rows"])
    return both.select(on, "source_rows", "target_rows", (~F.col("source_digest").eqNullSafe(F.col("target_digest"))).alias("differs"))


def bucket_counts(source: DataFrame, target: DataFrame, buckets: int = 100, **options) -> DataFrame:
    """bucket, source_rows, target_rows, diff_rows for each hash bucket of either side, by one grouping of hashes and one of buckets."""
    counts = _half_counts(source, target, **options).withColumn("bucket", half_bucket("hi", buckets))
    return counts.groupBy("bucket").agg(F.sum("source_n").alias("source_rows"), F.sum("target_n").alias("target_rows"), surplus().alias("diff_rows"))


def bucket_diff(source: DataFrame, target: DataFrame, buckets: int = 100, **options) -> DataFrame:
    """bucket, source_rows, target_rows, diff_rows for each hash bucket whose multisets differ.

    diff_rows is the larger one-sided surplus of row hashes in the bucket.
    """
    return bucket_counts(source, target, buckets, **options).filter("diff_rows > 0")


def bucket_digest_diff(source: DataFrame, target: DataFrame, buckets: int = 100, **options) -> DataFrame:
    """bucket, source_rows, target_rows for each bucket whose digests differ."""
    both = _both(bucket_digests(source, buckets, other=target, **options), bucket_digests(target, buckets, other=source, **options), "bucket")
    return both.filter("differs").drop("differs")


def chunk_checksum_diff(source: DataFrame, target: DataFrame, keys: list[str], chunk_rows: int = 50_000, **options) -> DataFrame:
    """chunk, source_rows, target_rows for each chunk in key order whose digests differ."""
    return chunk_checksums(source, target, keys, chunk_rows, **options).filter("differs").drop("differs")


def chunk_checksums(source: DataFrame, target: DataFrame, keys: list[str], chunk_rows: int = 50_000, **options) -> DataFrame:
    """chunk, source_rows, target_rows, differs for each chunk in key order of either side."""
    return _chunks_compared(*_placed(source, target, keys, chunk_rows, options))


def totals_and_checksums(source: DataFrame, target: DataFrame, keys: list[str], chunk_rows: int = 50_000, **options) -> tuple[DataFrame, DataFrame]:
    """``hash_totals`` and ``chunk_checksums``, from rows that are hashed once for both."""
    sides = _placed(source, target, keys, chunk_rows, options)
    return _totals(_counted(*sides)), _chunks_compared(*sides)


def _placed(source: DataFrame, target: DataFrame, keys: list[str], chunk_rows: int, options: dict) -> list[DataFrame]:
    return [placed_hashes(x, keys, chunk_rows, other=y, **options) for x, y in ((source, target), (target, source))]


def _chunks_compared(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(*[chunk_sums(x).select("chunk", F.col("n").alias("n_rows"), sums_line("chunk").alias("digest")) for x in (a, b)], "chunk")


def tables_equal(source: DataFrame, target: DataFrame, exact: bool = False, **options) -> DataFrame:
    """One row: source_rows, target_rows, equal; the tables are equal as multisets of hashable rows."""
    a = table_digest(source, exact=exact, other=target, **options).select(F.col("n_rows").alias("source_rows"), F.col("digest").alias("a"), F.lit(1).alias("one"))
    b = table_digest(target, exact=exact, other=source, **options).select(F.col("n_rows").alias("target_rows"), F.col("digest").alias("b"), F.lit(1).alias("one"))
    return a.join(b, "one").select("source_rows", "target_rows", ((F.col("a") == F.col("b")) & (F.col("source_rows") == F.col("target_rows"))).alias("equal"))


def lookup_keys(target: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the target whose key is in the sample."""
    return target.join(sample.select(*keys).distinct(), keys, "left_semi")


def key_collisions(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target already holds."""
    return df.join(target.select(*keys), keys, "left_semi")


def detect_keys(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """key, n_rows, n_distinct, n_nulls, is_key for each list of columns.

    Each candidate is proved by grouping on it, which spills and combines like any other grouping.
    """
    out = None
    for columns in candidates:
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        empty: Column = F.lit(False)
        for c in columns:
            empty = empty | F.col(c).isNull()
        row = groups.agg(
            F.lit(",".join(columns)).alias("key"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count_if(~empty).alias("n_distinct"),
            F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("n_nulls"),
        )
        row = row.withColumn("is_key", (F.col("n_rows") == F.col("n_distinct")) & (F.col("n_nulls") == 0))
        out = row if out is None else out.unionByName(row)
    return out


#: Relative standard deviation of the sketches of key discovery; a set of columns is given up where they have too few values in all combinations, each estimate taken FAR of these low.
SKETCH_ERROR, FAR = 0.05, 4
#: Sets of columns that one pass over the table looks at.
SETS = 16
#: Hashes that one pass groups: so many, or a part of PASSES of the rows where that is more; the first pass groups a part of FIRST of them, as most sets are given up there.
HASHES, PASSES, FIRST = 2**24, 4, 16


def discover_keys(df: DataFrame, most: int = 3, columns: list[str] | None = None) -> DataFrame:
    """key, n_rows, n_distinct, n_nulls, is_key: every smallest set of up to ``most`` columns that tells all rows apart and has no NULL.

    Level by level, from single columns on. A set is not looked at if a key is part of it, if a column has NULLs, or if its columns' distinct values, by sketches, are too few
    even in all combinations; what remains is proved or given up by ``_keys_among``. Columns are those of exact
    atomic types unless named. Names are listed in the order of the table. A table without rows has no keys.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns or [c for c, t in fields.items() if not isinstance(t, (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    counts: dict[str, float] = {}
    found: list[tuple[str, ...]] = []
    with shuffles_deleted(df.sparkSession):
        first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(names)]).first()
        n = first["n"]
        left = [c for k, c in enumerate(names) if n and first[f"_{k}"] == n]
        for at in range(0, len(left), SETS):
            part = left[at : at + SETS]
            told = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(f"_{k}") for k, c in enumerate(part)]).first()
            counts |= {c: told[f"_{k}"] / (1 - FAR * SKETCH_ERROR) for k, c in enumerate(part)}
        for size in range(1, most + 1):
            sets = [s for s in combinations(left, size) if not any(set(k) <= set(s) for k in found) and prod(counts[c] for c in s) >= n]
            found += [s for at in range(0, len(sets), SETS) for s in _keys_among(df, sets[at : at + SETS], n)]
    return df.sparkSession.createDataFrame([(",".join(s), n, n, 0, True) for s in found], "key string, n_rows bigint, n_distinct bigint, n_nulls bigint, is_key boolean")


def _keys_among(df: DataFrame, sets: list[tuple[str, ...]], n: int) -> list[tuple[str, ...]]:
    """Those of the sets, without NULLs in the n rows, that tell all rows apart.

    Rows are compared by 64-bit hashes, a slice of all hashes in each pass, so that the disk holds one slice at a time. A set stays while its hashes differ; it is given up
    when one repeats and the rows of that hash are seen to be equal. Where they are not, and where equal values may have different hashes, ``detect_keys`` decides.
    """
    hashable = {f.name for f in df.schema.fields if _equal_hashes(f.dataType)}
    open_sets = {k: s for k, s in enumerate(sets) if hashable.issuperset(s)}
    unsure = {k: s for k, s in enumerate(sets) if k not in open_sets}
    low, end, most = -(2**63), 2**63, max(HASHES, n // PASSES)
    while open_sets and low < end:
        take = most // FIRST if low == -end else most
        high = min(end, low + max(1, 2**64 * take // (n * len(open_sets))))
        hashes = df.select(*[_hash(s).alias(str(k)) for k, s in open_sets.items()]).unpivot([], [str(k) for k in open_sets], "k", "h")
        counted = hashes.filter(F.col("h").between(low, high - 1)).groupBy(F.col("k").cast("int").alias("k"), "h").agg(F.count(F.lit(1)).alias("n"))
        repeated = {r.k: r.h for r in counted.filter("n > 1").groupBy("k").agg(F.min("h").alias("h")).collect()}
        if repeated:
            equal = _all_equal(df, [(open_sets[k], h) for k, h in repeated.items()])
            unsure |= {k: open_sets[k] for k, same in zip(repeated, equal, strict=True) if not same}
            open_sets = {k: s for k, s in open_sets.items() if k not in repeated}
        low = high
    sure = open_sets | {k: s for k, s in unsure.items() if detect_keys(df, [list(s)]).first()["is_key"]}
    return [sure[k] for k in sorted(sure)]


def _hash(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def _equal_hashes(kind: T.DataType) -> bool:
    """Whether values that a grouping takes for equal have equal hashes, and have an order."""
    if isinstance(kind, T.StringType):
        return kind.isUTF8BinaryCollation()
    return isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _all_equal(df: DataFrame, asked: list[tuple[tuple[str, ...], int]]) -> list[bool]:
    """For each set of columns and hash, whether all rows of that hash have the same values."""
    here = [_hash(s) == h for s, h in asked]
    values = [F.when(x, F.struct(*[F.col(f"`{c}`") for c in s])) for x, (s, _) in zip(here, asked, strict=True)]
    row = df.filter(reduce(or_, here)).agg(*[(F.min(v) == F.max(v)).alias(f"_{k}") for k, v in enumerate(values)]).first()
    return list(row)
