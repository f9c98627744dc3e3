"""Key discovery keeps one slice of hashes on disk at a time, and tells rows apart exactly."""

import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import compare


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).endswith(".data")}


def _table(spark, rows: int = 3000):
    """b repeats in two rows, a with b too; a with c does not."""
    df = spark.range(rows).select((F.col("id") % 50).alias("a"), F.when(F.col("id") == 60, 10).otherwise(F.col("id")).alias("b"), F.floor(F.col("id") / 50).cast("string").alias("c"))
    return df.repartition(3)


def test_no_shuffle_files_stay(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name, None), _shuffle_files(spark)
    assert [r.key for r in compare.discover_keys(_table(spark)).collect()] == ["a,c", "b,c"]
    for _ in range(50):
        if not (stay := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not stay
    assert spark.conf.get(name, None) == setting


@pytest.mark.parametrize(("hashes", "passes", "first"), [(2**24, 4, 16), (40, 10**6, 1), (300, 7, 16), (1, 3, 1)])
def test_keys_by_slices_equal_counts(spark, monkeypatch, hashes, passes, first):
    for name, value in (("HASHES", hashes), ("PASSES", passes), ("FIRST", first)):
        monkeypatch.setattr(compare, name, value)
    df = _table(spark, 600).cache()
    n, unique = df.count(), []
    for size in (1, 2, 3):
        unique += [s for s in combinations(df.columns, size) if not any(set(k) <= set(s) for k in unique) and df.select(*s).distinct().count() == n]
    assert [tuple(r) for r in compare.discover_keys(df).collect()] == [(",".join(s), n, n, 0, True) for s in unique]
    df.unpersist()


def test_no_slice_misses_a_repeated_row(spark, monkeypatch):
    for name, value in (("HASHES", 100), ("PASSES", 10**6), ("FIRST", 2)):
        monkeypatch.setattr(compare, name, value)
    ids = spark.range(600).toDF("a")
    assert compare._keys_among(ids, [("a",)], 600) == [("a",)]
    for twice in range(0, 600, 100):
        assert compare._keys_among(ids.unionByName(ids.filter(F.col("a") == twice)), [("a",)], 601) == []


def test_equal_hashes_of_other_values_are_no_repetition(spark, monkeypatch):
    monkeypatch.setattr(compare, "_hash", lambda columns: F.xxhash64(*columns) % 7)
    assert [r.key for r in compare.discover_keys(_table(spark)).collect()] == ["a,c", "b,c"]


def test_values_equal_by_collation_are_no_key(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2)], "s string, i int").select(F.col("s").cast("string collate UTF8_LCASE").alias("s"), "i")
    assert [r.key for r in compare.discover_keys(df).collect()] == ["i"]


def test_commas_in_names(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a,b"), F.floor(F.col("id") / 10).alias("c"), F.lit(1).alias("d"))
    assert [r.key for r in compare.discover_keys(df).collect()] == ["a,b,c"]
