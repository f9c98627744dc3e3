"""Row hashes are grouped as two integers, which give the same hashes and buckets back."""

from pyspark.sql import functions as F

from ledgerline.functions.hashing import half_bucket, halves_hash, hash_bucket, hash_halves
from ledgerline.operators import compare


def test_halves_give_hash_and_bucket_back(spark):
    made = [F.md5(F.col("id").cast("string"))] + [F.lit(h) for h in ("0" * 32, "f" * 32, "0" * 16 + "8" + "0" * 15, "8" + "0" * 31, "7" + "f" * 31, "0" * 31 + "1")]
    rows = spark.range(50).select(F.explode(F.array(*made)).alias("h")).select("h", *hash_halves("h"))
    assert rows.filter("hi IS NULL OR lo IS NULL").isEmpty()
    assert rows.filter(halves_hash() != F.col("h")).isEmpty()
    for buckets in (7, 100, 4096):
        assert rows.filter(half_bucket("hi", buckets) != hash_bucket("h", buckets)).isEmpty()


def test_rows_are_grouped_by_numbers(spark):
    """A group by the hash's text holds 32 digits and a length for each row; at 60 times sf0.1 that was most of the time."""
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    for made in (compare.hash_totals(df, df), compare.bucket_counts(df, df), compare.hash_group_diff(df, df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [hi#" in plan and "Aggregate [h#" not in plan


def test_totals_equal_those_by_text(spark):
    a, b = spark.range(1000).select(F.col("id") % 37), spark.range(900).select((F.col("id") % 41).alias("(id % 37)"))
    counts = compare.hash_group_counts(a, b)
    want = counts.agg(F.sum("source_n"), F.sum("target_n"), compare.surplus()).first()
    assert tuple(compare.hash_totals(a, b).first()) == tuple(want)
    by_bucket = {r.bucket: tuple(r)[1:] for r in counts.groupBy(hash_bucket("h", 5).alias("bucket")).agg(F.sum("source_n"), F.sum("target_n"), compare.surplus()).collect()}
    assert {r.bucket: tuple(r)[1:] for r in compare.bucket_counts(a, b, 5).collect()} == by_bucket
