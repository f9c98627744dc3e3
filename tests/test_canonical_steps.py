"""Canonical texts of any length are those of all steps; hashes and sums stay what they were."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import functions as fn
from ledgerline.functions.canonical import NULL_TEXT, canonical, norm_decimal, norm_newlines, norm_timestamp, norm_uuid, rtrim_text
from ledgerline.functions.hashing import row_hash
from ledgerline.operators import compare, digests

UUID = "ABCDEFAB-ABCD-ABCD-ABCD-ABCDEFABCDEF"
TEXTS = ["", "A", "1.50", "-0.0", "1.", "a\r\nb", "1.0\r", "7.50\n", "0" * 25 + ".10", "2024-01-02 03:04:05", "2024-01-02 03:04:05.60", "2024-01-02 03:04:05+08", "2024-01-02 03:04:05\r\n", UUID, f"2024-01-02 03:04:05 {UUID}", f"{UUID}\r", f"é{UUID}", "9" * 40 + ".500", None]


def test_short_texts_take_the_same_steps(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for compat in (True, False):
        every = F.coalesce(norm_uuid(norm_timestamp(norm_decimal(norm_newlines("t")), compat)), F.lit(NULL_TEXT))
        got = df.select("t", canonical("t", T.StringType(), compat=compat).alias("a"), every.alias("b")).collect()
        assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got]


def test_trailing_blanks(spark):
    df = spark.createDataFrame([(t,) for t in ["a \t\r\n", "a\n b ", " ", "", "a ", None]], "t string")
    assert [r.x for r in df.select(rtrim_text("t").alias("x")).collect()] == ["a", "a\n b", "", "", "a ", None]


def test_texts_are_worked_out_once_and_hash_alike(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    for style in ("safe", "compat"):
        rows = digests.hashed(orders, style=style)
        assert rows.exceptAll(orders.select(row_hash(orders, style=style).alias("h"))).isEmpty()
    plan = digests.hashed(orders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format") == 1


def test_sums_of_halves(spark):
    rows = spark.createDataFrame([("f" * 32,)] * 3 + [("0" * 32,)], "h string")
    got = rows.agg(*digests.hash_sums()).first()
    assert (got.n, int(got.s1), int(got.s2), int(got.s3)) == (4, 3 * (16**15 - 1), 3 * (16**15 - 1), 3 * 255)


def test_keys_are_proved_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)], "a int, b int, c int")
    asked = []
    proof = compare.detect_keys
    monkeypatch.setattr(compare, "detect_keys", lambda df, sets: asked.extend(map(tuple, sets)) or proof(df, sets))
    assert [tuple(r) for r in compare.discover_keys(df).collect()] == [("a,b", 4, 4, 0, True)]
    assert len(asked) == len(set(asked))
