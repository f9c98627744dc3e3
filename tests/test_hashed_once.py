"""Keyed tables are hashed once for totals and chunks, chunks are compared by sums, and digests read each hash as two integers."""

import hashlib

from pyspark.sql import functions as F

from ledgerline.functions.hashing import row_hash
from ledgerline.operators import compare, digests
from ledgerline.plans.validate import validate_full


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_full_hashes_keyed_rows_once(spark):
    a = spark.range(500).withColumn("t", F.col("id").cast("string"))
    report = validate_full(a, a.filter("id <> 7"), "t", ["id"])
    assert "md5(" not in plan(report)
    assert tuple(report.first())[2:6] == ("fail", 500, 499, 1)


def test_totals_and_checksums_are_those_of_each(spark):
    a = spark.range(900).select((F.col("id") % 300).alias("k"), (F.col("id") % 7).alias("v"))
    b = a.filter("k <> 211").withColumn("v", F.when(F.col("k") == 250, -1).otherwise(F.col("v")))
    totals, chunks = compare.totals_and_checksums(a, b, ["k"], 100)
    assert tuple(totals.first()) == tuple(compare.hash_totals(a, b).first())

    def listed(df, other):
        return {r.chunk: (r.n_rows, r.digest) for r in digests.chunk_digests(df, ["k"], 100, other=other).collect()}

    s, t = listed(a, b), listed(b, a)
    want = {c: (s.get(c, (0,))[0], t.get(c, (0,))[0], s.get(c) != t.get(c)) for c in s.keys() | t.keys()}
    assert {r.chunk: (r.source_rows, r.target_rows, r.differs) for r in chunks.collect()} == want
    assert {d for *_, d in want.values()} == {True, False}


def test_chunks_follow_hashes_without_sign(spark):
    """Rows of one key lie in the order of their hashes' texts, so hashes from 8 on are after the others."""
    df = spark.range(64).select(F.lit(1).alias("k"), "id")
    rows = digests.placed_hashes(df, ["k"], 10).select(F.lower(F.lpad(F.hex("hi"), 16, "0")).alias("h"), "chunk").collect()
    assert all(max(r.h for r in rows if r.chunk == c) < min(r.h for r in rows if r.chunk == c + 1) for c in range(6))


def test_chunks_are_compared_by_sums(spark):
    df = spark.range(10)
    assert "collect_list" not in plan(compare.chunk_checksums(df, df, ["id"], 5))


def test_digest_reads_a_hash_as_two_integers(spark):
    df = spark.range(50)
    assert plan(digests.table_digest(df)).count("conv(") == 2
    parts = [(int(h[:8], 16) % 7, h) for h in (r.h for r in df.select(row_hash(df).alias("h")).collect())]
    want = {b: [x for y, x in parts if y == b] for b, _ in parts}
    got = {r.bucket: (r.n, int(r.s1), int(r.s2), int(r.s3)) for r in digests.digest_sums(df, 7).collect()}
    assert got == {b: (len(hs), *[sum(int(h[i:j], 16) for h in hs) for i, j in ((0, 15), (15, 30), (30, 32))]) for b, hs in want.items()}


def test_safe_hash_is_one_concatenation(spark):
    rows = [("a|b", "é"), ("", None), (None, None), ("N", "x" * 40)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.h for r in df.select(row_hash(df).alias("h")).collect()] == [hashlib.md5("|".join("N" if t is None else f"{len(t)}:{t}" for t in row).encode()).hexdigest() for row in rows]
    assert "concat_ws" not in plan(digests.hashed(df))
