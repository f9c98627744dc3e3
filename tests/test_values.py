"""Decoding of change values, and names told without regard to case."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.decode import decode_value
from ledgerline.streaming import changes as ch
from ledgerline.streaming.feed import VersionedTable, apply_batch


def decode(spark, ddl, values, **options):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = rows.select("k", decode_value(F.col("v"), T._parse_datatype_string(ddl), **options).alias("d")).collect()
    return [r.d for r in sorted(got)]


CASES = [
    ("binary", {"\\x0aff": b"\n\xff", "\\x": b"", "\\xzz": None, "\\x0": None, "plain é": "plain é".encode(), "": b"", None: None}),
    ("boolean", {"t": True, "f": False, "1": True, "0": False, "yes": True, "maybe": None}),
    ("array<int>", {"{1,2,NULL}": [1, 2, None], "{}": [], " {1}": None, "{ 1 , 2 }": [1, 2], "[0:1]={5,6}": [5, 6], "[1,null]": [1, None], "{1,,2}": None, "{1}{2}": None, "{1}}": None, "{{1}}": None, "{1,x}": None, "{1": None, "{,}": None, "abc": None, "": None}),
    ("array<string>", {'{a,"b,c","d\\"e",NULL,"NULL"}': ["a", "b,c", 'd"e', None, "NULL"], '{"{x}"," y "}': ["{x}", " y "], "{a\\,b}": ["a,b"], '{"x}': None, '{a "b"}': None, '["q",null,1]': ["q", None, "1"], '{"\t\\\\"}': ["\t\\"]}),
    ("array<array<int>>", {"{{1,2},{3,NULL}}": [[1, 2], [3, None]], "{{},{}}": [[], []], "{{1},2}": None, "{1}": None, "{{1,x}}": None, "[[1],[]]": [[1], []]}),
    ("array<binary>", {'{"\\\\x0aff",NULL}': [b"\n\xff", None], '{"\\\\x0"}': None}),
    ("array<boolean>", {"{t,f,NULL}": [True, False, None]}),
    ("struct<a:int,b:string>", {'{"a":1,"b":"x"}': (1, "x"), "nope": None}),
    ("map<string,int>", {'{"a":1}': {"a": 1}, "nope": None}),
    ("decimal(6,2)", {"1.5": 1.5, "n/a": None}),
]


@pytest.mark.parametrize(("ddl", "cases"), CASES, ids=[c[0] for c in CASES])
def test_values(spark, ddl, cases):
    assert decode(spark, ddl, list(cases)) == list(cases.values())


def test_length_limit(spark):
    assert decode(spark, "string", ["🙂é!x", "ab", None], max_length=3) == ["🙂é!", "ab", None]
    assert decode(spark, "array<string>", ["{abcd,NULL}"], max_length=3) == [["abc", None]]


def literal(value):
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "{" + ",".join(map(literal, value)) + "}"
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


items = st.one_of(st.none(), st.text(st.sampled_from('ab{},"\\ \n\'éN'), max_size=6))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(items, max_size=4), max_size=3), min_size=1, max_size=20))
def test_any_nested_array_comes_back(spark, values):
    assert decode(spark, "array<array<string>>", [literal(v) for v in values]) == values


BASE = "Id bigint, Payload binary, Tags array<string>, Grid array<array<int>>, `No te` string"
NAMES = {"id": "Id", "payload": "Payload", "tags": "Tags", "grid": "Grid", "no te": "No te"}


def cell(name, value, key=False, kind="text"):
    return {"name": name, "value": value, "type": kind, "is_key": key, "unchanged": False}


def feed(spark, rows):
    return ch.decode_changes(spark.createDataFrame([(k, 0, None, kind, "public", "t", new, old, None) for k, (kind, new, old) in enumerate(rows)], ch.RAW_SCHEMA))


def replay(base, rows):
    """The feed one event at a time, of values given as (text, value)."""
    table = {r[0]: dict(zip(("id", "payload", "tags", "grid", "no te"), r, strict=True)) for r in base}
    for kind, key, cells in rows:
        if kind == "insert":
            table[key] = dict.fromkeys(NAMES) | {"id": key} | cells
        elif kind == "update" and key in table:
            table[key] |= cells
        elif kind == "delete":
            table.pop(key, None)
    return sorted((tuple(r.values()) for r in table.values()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_typed_feeds_against_replay(spark, seed):
    rng = random.Random(seed)
    base = [(k, bytes([k]), [f"t{k}"], [[k], []], None) for k in range(4)]
    values = {
        "payload": lambda: rng.choice([("\\x0aff", "bytea", b"\n\xff"), ("\\x41", "text", b"\\x41"), ("raw", None, b"raw"), (None, "bytea", None)]),
        "tags": lambda: rng.choice([('{a,"b\\"",NULL}', "_text", ["a", 'b"', None]), ('["j"]', "jsonb", ["j"]), ("{}", None, []), ("bad", "text", None)]),
        "grid": lambda: rng.choice([("{{1,2},{NULL}}", None, [[1, 2], [None]]), ("{1}", None, None), (None, None, None)]),
        "no te": lambda: rng.choice([("x" * 9, None, "x" * 5), ("é", None, "é")]),
    }
    rows, plain = [], []
    for _ in range(40):
        key, kind = rng.randrange(6), rng.choice(["insert", "update", "update", "delete"])
        case = rng.choice([str.lower, str.upper, str.title])
        told = {n: values[n]() for n in values if rng.random() < 0.5}
        own = cell(case("id"), str(key), True, "int8")
        new = [own, *[cell(case(n), text, kind=source) for n, (text, source, _) in told.items()]]
        rows.append((kind, None, [own]) if kind == "delete" else (kind, new, None))
        plain.append((kind, key, {n: v for n, (*_, v) in told.items()}))
    table = spark.createDataFrame(base, BASE)
    got = ch.apply_changes(table, feed(spark, rows), ["ID"], max_length=5)
    assert got.columns == table.columns
    found = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()), key=repr)
    assert found == replay(base, plain)


def test_exact_names_before_others(spark):
    # Case-sensitive tables may have both; an event with two spellings of one column counts by the exact one.
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ID", T.StringType()), T.StructField("Name", T.StringType())])
    rows = feed(spark, [("insert", [cell("id", "1", True), cell("ID", "x"), cell("NAME", "n")], None), ("update", [cell("Id", "1", True), cell("Name", "m")], None), ("update", [cell("id", "1", True), cell("Name", "a"), cell("name", "b")], None)])
    got = [(r.key, r.new, sorted(r.set_cols)) for r in ch.conform_events(rows, schema).orderBy("lsn").collect()]
    assert got[0] == ({"id": "1"}, {"id": "1", "ID": "x", "Name": "n"}, ["ID", "Name", "id"])
    assert got[1][0] == {"Id": "1"}
    assert got[2][1] == {"id": "1", "Name": "a", "name": "b"}
    reasons = {r.lsn: r.reason for r in ch.reject_misfits(rows, schema, ["id"])[1].collect()}
    assert reasons == {1: "no such column: Id; no value for key column: id", 2: "no such column: name"}
    with pytest.raises(ValueError, match="may be"):
        ch.resolve(schema, ["Id"])
    with pytest.raises(ValueError, match="no column"):
        ch.resolve(schema, ["other"])


def test_events_without_their_key_do_nothing_but_are_rejected(spark):
    base = spark.createDataFrame([(1, b"a", None, None, "n")], BASE)
    rows = feed(spark, [("insert", [cell("tags", "{}")], None), ("update", [cell("other", "1", True), cell("no te", "x")], None), ("delete", None, [cell("other", "1", True)])])
    assert ch.apply_changes(base, rows, ["Id"]).collect() == base.collect()
    good, bad = ch.reject_misfits(rows, base.schema, ["Id"])
    assert good.count() == 0 and bad.count() == 3


def test_events_without_types(spark):
    base = spark.createDataFrame([(1, b"a", None, None, "n")], BASE)
    rows = feed(spark, [("update", [cell("ID", "1", True), cell("PAYLOAD", "\\x00")], None)]).drop("types")
    assert bytes(ch.apply_changes(base, rows, ["Id"]).first().Payload) == b"\0"


def test_streams_stop_at_unknown_columns_and_keep_binary_keys(spark, tmp_path):
    schema = "K binary, V array<int>"
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.write(spark.createDataFrame([(b"\xff", [1]), (b"\xfe", [2])], schema), 0)
    run = apply_batch({"t": table}, str(tmp_path / "state"))
    run(feed(spark, [("update", [cell("k", "\\xff", True, "bytea"), cell("v", "{7,8}")], None), ("insert", [cell("K", "\\xfd", True, "bytea")], None)]), 0)
    assert sorted((bytes(r.K), r.V) for r in table.read().collect()) == [(b"\xfd", None), (b"\xfe", [2]), (b"\xff", [7, 8])]
    with pytest.raises(ValueError, match="no such column: colour"):
        run(feed(spark, [("update", [cell("k", "\\xff", True, "bytea"), cell("colour", "red")], None)]), 1)
