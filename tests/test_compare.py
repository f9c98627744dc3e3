"""Properties that hold for any table, and drift with known answers."""

import pytest
from pyspark.sql import functions as F

from ledgerline import fixtures
from ledgerline.operators import chunks, compare, digests, sampling
from ledgerline.plans.validate import MODES, choose_strategy, validate, validate_estimates
from ledgerline.session import stored
from ledgerline.sources.tables import estimate_rows_by_statistics


@pytest.fixture(scope="module")
def lineitem(spark, data):
    # Stored, as a cache would also stand in for the scans of other tests.
    return stored(fixtures.table(spark, data, "lineitem"))


@pytest.mark.parametrize("exact", [True, False])
def test_digest_ignores_order_of_rows_columns_and_partitions(spark, lineitem, exact):
    first = digests.table_digest(lineitem, exact=exact).first()
    other = lineitem.select(*reversed(lineitem.columns)).repartition(7).orderBy("l_shipdate")
    assert digests.table_digest(other, exact=exact).first() == first
    assert digests.table_digest(lineitem.union(lineitem.limit(1)), exact=exact).first() != first
    assert digests.table_digest(lineitem.limit(0), exact=exact).first()["n_rows"] == 0


def test_difference_with_itself_is_empty(lineitem):
    assert compare.hash_group_diff(lineitem, lineitem).isEmpty()
    assert compare.bucket_digest_diff(lineitem, lineitem).isEmpty()
    assert compare.missing_rows(lineitem, lineitem).isEmpty()


def test_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, v string")
    assert [(r.k, r.source_value, r.target_value) for r in compare.column_diff(a, b, ["k"]).collect()] == [(2, "", None)]
    assert compare.hash_group_diff(a, b).count() == 2


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_position_chunks_hold_every_row_once(spark, rows):
    skewed = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
    got = chunks.position_chunks(skewed, ["k", "id"], rows).collect()
    assert sorted(r.position for r in got) == list(range(500))
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r.id for r in skewed.orderBy("k", "id").collect()]
    assert all(r.chunk == r.position // rows for r in got)


@pytest.mark.parametrize("partitions,adaptive", [(64, "true"), (200, "false")])
def test_positions_of_many_wide_rows(spark, partitions, adaptive):
    """Enough rows for sampled ranges, written with a column that is no key: every position once, in order."""
    n = 3_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(n).select(F.pmod(F.col("id") * 1_000_003, F.lit(n)).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
        got = chunks.position_chunks(df, ["k"], 1000)
        row = got.agg(F.count("*"), F.count_if(F.col("k") != F.col("position")), F.max("position"), F.count_distinct("position"), F.count("v")).first()
        assert tuple(row) == (n, 0, n - 1, n, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sample_window_and_estimates(spark, lineitem):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    first = sampling.sample_window(lineitem, 0.01, keys, seed=3)
    got = [tuple(r) for r in first.select(*keys).collect()]
    whole = [tuple(r) for r in lineitem.orderBy(*keys).select(*keys).collect()]
    assert len(got) == sampling.sample_size(len(whole), 0.01)
    assert any(got == whole[k : k + len(got)] for k in range(len(whole)))
    starts = {tuple(sampling.sample_window(lineitem, 0.01, keys, seed=s).select(*keys).first()) for s in range(4)}
    assert len(starts) > 1
    assert estimate_rows_by_statistics(lineitem).first()[0] > 0
    assert validate_estimates(lineitem, lineitem, "t", statistics=True).first()["status"] == "pass"


def test_range_chunks_cover_the_keys(spark):
    df = spark.range(3, 1000, 7).withColumnRenamed("id", "k")
    parts = chunks.range_chunks(df, "k", 20).orderBy("chunk").collect()
    assert parts[0].lo == 3 and parts[-1].is_last and parts[-1].hi is None
    assert all(a.hi == b.lo for a, b in zip(parts, parts[1:]))
    counts = {r.chunk: r.n for r in chunks.assign_chunk(df, "k", 20).groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    for p in parts:
        assert counts.get(p.chunk, 0) == df.filter((F.col("k") >= p.lo) & (F.lit(True) if p.is_last else F.col("k") < F.lit(p.hi))).count()
    assert chunks.range_chunks(df.limit(0), "k", 20).isEmpty()
    assert chunks.assign_chunk(df.limit(0), "k", 20).isEmpty()


def test_equal_counts_swapped_content(spark, data):
    customer = fixtures.table(spark, data, "customer")
    swap = F.when(F.col("c_mktsegment") == "BUILDING", "MACHINERY").when(F.col("c_mktsegment") == "MACHINERY", "BUILDING").otherwise(F.col("c_mktsegment"))
    pair = {"customer": (customer, customer.withColumn("c_mktsegment", swap))}
    status = {mode: validate(pair, mode, {"customer": ["c_custkey"]}).first()["status"] for mode in MODES if mode not in ("sample", "auto", "light")}
    assert status == {"quick": "pass", "quick-estimate": "pass", "hash_group": "fail", "aggregate": "fail", "bucket": "fail", "checksum": "fail", "full": "fail"}
    same = {"customer": (customer, customer.repartition(5))}
    assert all(validate(same, mode, {"customer": ["c_custkey"]}).first()["status"] == "pass" for mode in MODES)


def test_strategy_sizes_and_unknown_modes(spark):
    assert [choose_strategy(n, k) for n, k in ((5, ["k"]), (1_000_000, None), (1_000_001, None))] == ["sample", "hash_group", "aggregate"]
    assert [sampling.sample_size(n, 0.01) for n in (0, 50, 5000, 10**7)] == [1, 1, 50, 1000]
    with pytest.raises(ValueError):
        validate({}, "nothing")


def test_detect_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], "x int, y int, z string")
    got = {r.key: r.is_key for r in compare.detect_keys(df, [["x"], ["x", "y"], ["z"]]).collect()}
    assert got == {"x": False, "x,y": False, "z": True}


def test_keys_are_discovered(spark):
    rows = [(a, b, c, None if a == b == c == 0 else a, "x") for a in range(12) for b in range(12) for c in range(12)]
    df = spark.createDataFrame([(*r, k, float(k)) for k, r in enumerate(rows)], "a int, b int, `c d` int, e int, f string, g int, h double").drop("g")
    assert [r.key for r in compare.discover_keys(df).collect()] == ["a,b,c d"]
    assert compare.discover_keys(df, most=2).count() == 0
    numbered = df.withColumn("id", F.monotonically_increasing_id()).withColumn("twin", F.col("id") * 2)
    assert sorted(r.key for r in compare.discover_keys(numbered).collect()) == ["a,b,c d", "id", "twin"]
    assert [r.key for r in compare.discover_keys(numbered, columns=["a", "id"]).collect()] == ["id"]
    # Nearly unique is no key.
    nearly = numbered.unionByName(numbered.limit(1))
    assert compare.discover_keys(nearly, most=1).count() == 0
    assert compare.discover_keys(df.limit(0)).count() == 0


def test_sets_that_cannot_be_keys_are_not_counted(spark, monkeypatch):
    proved = []
    detect = compare.detect_keys
    monkeypatch.setattr(compare, "detect_keys", lambda df, sets: proved.extend(sets) or detect(df, sets))
    df = spark.range(2000).select("id", (F.col("id") % 10).alias("ten"), F.floor(F.col("id") / 10).alias("rest"), (F.col("id") % 3).alias("three"))
    assert sorted(r.key for r in compare.discover_keys(df, most=2).collect()) == ["id", "ten,rest"]
    assert sorted(map(tuple, proved)) == [("id",), ("id",), ("ten", "rest"), ("ten", "rest")]
