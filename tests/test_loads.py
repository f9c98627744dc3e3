"""Loads that are stopped and go on, and JDBC ranges of keys that are no integers."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import report
from ledgerline.sources import loads
from ledgerline.sources import tables as src

SCHEMA = "a string, b int, v double"
ROWS = [(None if k % 17 == 0 else f"k{k % 23}", None if k % 13 == 0 else k, k / 4) for k in range(400)] + [("k5", 7, 1.0)] * 30


class Killed(Exception):
    pass


def state(df):
    return sorted(map(repr, map(tuple, df.collect())))


def frame(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)


def killed_after(n):
    seen = []

    def after(chunk):
        seen.append(chunk)
        if len(seen) == n:
            raise Killed

    return after


@pytest.mark.parametrize("policy", loads.POLICIES)
def test_a_killed_load_goes_on(spark, tmp_path, monkeypatch, policy):
    monkeypatch.setattr(loads, "WAVE", 4)
    root = str(tmp_path / "t")
    old = spark.createDataFrame([("old", -1, 0.0), ("old", -2, 0.0)], SCHEMA)
    old.write.parquet(root)
    source = frame(spark)
    load = loads.ChunkedLoad(source, root, ["a", "b"], 40, policy)
    with pytest.raises(Killed):
        load.run(killed_after(3))
    assert load.ledger().count() == 3
    assert report.load_progress(load.ledger()).first().progress == 1.0
    # Killed once more, with a chunk's files in the table and no row of it in the ledger.
    put = loads.Folder.put

    def broken(self, name, text):
        if name.startswith("_load/ledger/") and len(self.names("_load/ledger")) == 5:
            raise Killed
        put(self, name, text)

    monkeypatch.setattr(loads.Folder, "put", broken)
    with pytest.raises(Killed):
        loads.load(source, root, ["a", "b"], 40, policy)
    monkeypatch.setattr(loads.Folder, "put", put)
    ledger = loads.load(source, root, ["a", "b"], 40, policy)
    assert state(spark.read.schema(SCHEMA).parquet(root)) == state(source if policy != "insert" else source.unionByName(old))
    assert ledger.agg(F.sum("rows_done")).first()[0] == len(ROWS) and {r.state for r in ledger.collect()} == {"completed"}
    assert [n for n in load.folder.names("") if n.startswith("_")] == ["_SUCCESS"]


def test_loads_that_have_ended_begin_anew(spark, tmp_path):
    root = str(tmp_path / "t")
    loads.load(frame(spark), root, ["a", "b"], 100)
    with pytest.raises(ValueError, match="already in"):
        loads.load(frame(spark), root, ["a", "b"], 100)
    loads.load(frame(spark, [("new", 1, 2.0)]), root, ["a", "b"], 100)
    assert spark.read.parquet(root).count() == len(ROWS) + 1
    loads.load(frame(spark).drop("v"), root, ["b"], 100, "drop")
    assert spark.read.parquet(root).columns == ["a", "b"] and spark.read.parquet(root).count() == len(ROWS)
    with pytest.raises(ValueError, match="others than those"):
        loads.load(frame(spark), root, ["a", "b"], 100, "truncate")
    loads.load(frame(spark).select("a", F.col("b").cast("long").alias("b")), root, ["b"], 100, "truncate")
    assert dict(spark.read.parquet(root).dtypes)["b"] == "int"
    loads.load(frame(spark, []).drop("v"), root, ["b"], 100, "truncate")
    assert loads.ChunkedLoad(frame(spark), root, ["b"]).folder.names("_load") == []


def test_another_load_of_the_table_waits(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(Killed):
        loads.ChunkedLoad(frame(spark), root, ["a", "b"], 100).run(killed_after(1))
    with pytest.raises(ValueError, match="has not ended"):
        loads.load(frame(spark), root, ["a", "b"], 100, "drop")
    assert loads.load(frame(spark), root, ["a", "b"], 100).count() > 1
    assert state(spark.read.schema(SCHEMA).parquet(root)) == state(frame(spark))


def test_chunks_hold_their_rows(spark, tmp_path):
    rows = [(None, k, 0.0) for k in range(500)]
    ledger = loads.load(frame(spark, rows), str(tmp_path / "t"), ["b"], 50)
    assert [(r.chunk, r.rows_done) for r in ledger.orderBy("chunk").collect()] == [(k, 50) for k in range(10)]
    assert state(spark.read.schema(SCHEMA).parquet(str(tmp_path / "t"))) == state(frame(spark, rows))


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    rows = [(None if k % 31 == 0 else f"o'k{k % 7}", None if k % 29 == 0 else k // 3, datetime.date(2024, 1, 1 + k % 20), str(k)) for k in range(300)] + [("hot", 1, datetime.date(2024, 5, 5), "x")] * 60
    df = spark.createDataFrame(rows, "name string, n int, d date, v string")
    # This database takes no NULL texts from Spark, so they are set there.
    src.write_jdbc(df.withColumn("name", F.nullif(F.coalesce("name", F.lit("<null>")), F.lit(""))), url, "t", mode="overwrite", createTableColumnTypes="name VARCHAR(20), v VARCHAR(20)", **DERBY)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute("""UPDATE t SET "name" = NULL WHERE "name" = '<null>'""")
    connection.close()
    return url, df


@pytest.mark.parametrize("keys", [['"name"'], ['"name"', '"n"'], ['"d"', '"name"'], ['"n"']])
def test_jdbc_by_any_key(spark, url, keys):
    where, df = url
    got = loads.read_jdbc_by_key(spark, where, "t", keys, 25, DERBY)
    assert state(got) == state(df)
    sizes = got.rdd.glom().map(len).collect()
    assert len(sizes) > 4
    # Only a key that repeats makes a part larger.
    if keys == ['"n"']:
        assert max(sizes[1:]) <= 25 + 60 + 3


def test_jdbc_of_an_empty_table_and_of_one_key(spark, url, tmp_path):
    where = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([("x", 1)] * 9, "name string, n int")
    src.write_jdbc(df.limit(0), where, "empty_one", mode="overwrite", createTableColumnTypes="name VARCHAR(20)", **DERBY)
    assert loads.read_jdbc_by_key(spark, where, "empty_one", ['"name"'], 5, DERBY).count() == 0
    src.write_jdbc(df, where, "one_key", mode="overwrite", createTableColumnTypes="name VARCHAR(20)", **DERBY)
    assert loads.read_jdbc_by_key(spark, where, "one_key", ['"name"'], 2, DERBY).count() == 9
    # A chunked load from a database.
    loads.load(loads.read_jdbc_by_key(spark, url[0], "t", ['"name"', '"n"'], 50, DERBY), str(tmp_path / "t"), ["name", "n"], 50)
    assert state(spark.read.parquet(str(tmp_path / "t")).select("name", "n", "d", "v")) == state(url[1])


def test_predicates_are_disjoint_and_complete(spark):
    rows = spark.createDataFrame([(a, b) for a in (None, "a", "b", "c") for b in (None, 1, 2, 3)], "a string, b int")
    parts = loads.key_predicates(["a", "b"], [("a", 2), ("b", 1), ("c", 3)])
    assert [rows.filter(p).count() for p in parts] == [7, 1, 2, 5, 1]
    assert loads._literal(datetime.datetime(2024, 1, 2, 3, 4, 5)) == "{ts '2024-01-02 03:04:05'}" and loads._literal(True) == "TRUE"
