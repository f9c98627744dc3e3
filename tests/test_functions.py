from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import ledgerline.functions as fn


def apply(spark, f, values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(f("v")).collect()]


@pytest.mark.parametrize(
    "function,pairs",
    [
        (fn.norm_newlines, {"one\r\n\r\ntwo": "one\n\ntwo", "\r": "\n", "zeile\r\räöü": "zeile\n\näöü", "\n\r\n\r": "\n\n\n", "": ""}),
        (lambda c: fn.norm_timestamp(c, compat=False), {"1999-12-31 23:59:59-02:30": "2000-01-01 02:29:59", "1999-12-31 23:59:59.125Z": "1999-12-31 23:59:59", "1999-12-31 23:59:59.7": "1999-12-31 23:59:59", "1999-12-31 23:59:59 at night": "1999-12-31 23:59:59 at night"}),
        (fn.norm_uuid, {"<0F8FAD5B-D9CB-469F-A165-70867728950E>": "<0f8fad5b-d9cb-469f-a165-70867728950e>", "0F8FAD5B-D9CB": "0F8FAD5B-D9CB"}),
        (fn.norm_json_ws, {'[ {"k k" : "v\\" : v"} ,\t2 ]': '[{"k k":"v\\" : v"},2]', '"no  end': '"noend'}),
        (fn.pg_array_to_json, {"{ }": "[null]", "{-7,1e9,.5}": "[-7,1e9,.5]", "{f,NULL,word}": '[false,null,"word"]', '{"c, d","back\\\\slash"}': '["c, d","back\\\\slash"]', "{{},{a}}": '[[],["a"]]', "{open": "{open"}),
        (fn.canonical_light, {"7.250\t": "7.25", "v.0": "v", "9000": "9000"}),
        (lambda c: fn.truncate_values(c, 2), {"xyz": "xy", "🙂é!": "🙂é", "x": "x"}),
    ],
)
def test_texts(spark, function, pairs):
    assert apply(spark, function, list(pairs)) == list(pairs.values())


FAST = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FAST
@given(st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(0, 9)), min_size=1, max_size=30))
def test_decimals_lose_nothing_but_zeros(spark, values):
    """Any plain decimal keeps its value and ends in no zero and no point; texts of another form stay."""
    texts = [format(Decimal(n).scaleb(-places), "f") for n, places in values]
    for text, got in zip(texts, apply(spark, fn.norm_decimal, texts)):
        assert Decimal(got) == Decimal(text) and not ("." in got and got.endswith(("0", ".")))
    odd = ["7.", ".70", "7.70 ", "+7.70", "7.7.0", "7,70", "7e-10", "x7.0"]
    assert apply(spark, fn.norm_decimal, odd) == odd


@FAST
@given(st.lists(st.text(alphabet="ab \t\r\n\u00a0.", max_size=10), min_size=1, max_size=30))
def test_only_trailing_blanks_go(spark, values):
    assert apply(spark, fn.rtrim_text, values) == [v.rstrip(" \t\r\n") for v in values]


@FAST
@given(st.lists(st.tuples(st.datetimes(), st.sampled_from(["", ".1", ".000200", "Z", "+01", "-09:30", ".5+14:00", " odd"])), min_size=1, max_size=30))
def test_timestamps_are_cut_to_seconds(spark, values):
    texts = [f"{at:%Y-%m-%d %H:%M:%S}".rjust(19, "0") + more for at, more in values]
    assert apply(spark, fn.norm_timestamp, texts) == [t[:19] for t in texts]
    others = ["31.12.1999", "1999-12-31T23:59:59", "23:59:59", " 1999-12-31 23:59:59"]
    assert apply(spark, fn.norm_timestamp, others) == others


def test_canonical_by_type(spark):
    row = spark.sql(
        "SELECT false AS b, -12 AS i, 30.7500BD AS d, 2.5e11D AS x, 0.3D AS y, CAST('-Infinity' AS DOUBLE) AS z, TIMESTAMP_NTZ'1987-06-05 04:03:02.9' AS t, DATE'1987-06-05' AS day, CAST(NULL AS STRING) AS n, array('p', NULL) AS a, 'Q\rR' AS s"
    )
    got = row.select(*[fn.canonical(f.name, f.dataType).alias(f.name) for f in row.schema.fields]).first().asDict()
    assert got == {"b": "0", "i": "-12", "d": "30.75", "x": "250000000000", "y": "0.3", "z": "-Infinity", "t": "1987-06-05 04:03:02", "day": "1987-06-05", "n": "\\N", "a": '["p",null]', "s": "Q\nR"}
    assert row.select(fn.canonical("x", T.DoubleType(), float_digits=2)).first()[0] == "250000000000"


def test_export_text_and_bytes(spark):
    row = spark.sql("SELECT -3 AS i, 'x\ny' AS s, 0.250BD AS d, false AS b, TIMESTAMP_NTZ'1987-06-05 04:03:02' AS t, CAST(NULL AS INT) AS n, '\\\\N' AS m, 1.75D AS f")
    got = list(row.select(*[fn.export_text(f.name, f.dataType) for f in row.schema.fields]).first())
    assert got == ["-3", "x\\ny", "0.250", "0", "1987-06-05 04:03:02", "\\N", "\\\\N", "1.75"]
    assert apply(spark, fn.bytea_to_binary, ["\\x00ffA7", "text", "\\x123", "\\x"]) == [b"\x00\xff\xa7", b"text", b"\\x123", b""]
    assert apply(spark, fn.format_duration, [0.25, 119.5, 7322.125], "v double") == ["0.250s", "1m59.500s", "2h2m2.125s"]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\\Nntr\t\n\r\0\1\2 é🙂", max_size=12), min_size=1, max_size=40))
def test_escape_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, back in df.select("v", fn.tsv_unescape(fn.tsv_escape("v"))).collect():
        assert back == v


def test_byte_diff(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("abc", "abcd"), ("", "x"), ("é", "e")], "a string, b string")
    got = df.select(fn.byte_diff("a", "b").alias("d")).select("d.*").collect()
    assert [r.at for r in got] == [2, None, 3, 0, 0]
    assert got[2].tail_b == "64" and got[4].len_a == 2


def test_row_hash_and_buckets(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", "x", "c"), ("a", None, "c"), ("a", "\\N", "c")], "p string, q string, r string")
    safe = [r[0] for r in df.select(fn.row_hash(df)).collect()]
    compat = [r[0] for r in df.select(fn.row_hash(df, style="compat")).collect()]
    assert len(set(safe)) == 4 and len(set(compat)) == 3
    shuffled = df.select("r", "p", "q")
    assert [r[0] for r in shuffled.select(fn.row_hash(shuffled)).collect()] == safe
    joined = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "p string, q string")
    assert len({r[0] for r in joined.select(fn.row_hash(joined)).collect()}) == 2
    assert len({r[0] for r in joined.select(fn.row_hash(joined, style="compat")).collect()}) == 1
    assert apply(spark, lambda c: fn.hash_bucket(c, 100), ["a1b2c3d4" + "0" * 24, "ffffffff" + "0" * 24]) == [16, 95]


def test_hashable_columns(spark):
    a = spark.createDataFrame([], "Id long, x double, s string, m map<string,string>, only_a int")
    b = spark.createDataFrame([], "id long, x decimal(9,2), S string, m string")
    assert fn.hashable_columns(a, b) == ["id", "s"]
    assert fn.hashable_columns(a, b, float_digits=2) == ["id", "s", "x"]
    marked = a.select("Id", F.col("s").alias("s", metadata={"json": True}))
    assert fn.hashable_columns(marked) == ["id"]
