"""Text files, write policies, ledgers, JDBC on the bundled database."""

import pytest
from pyspark.sql import functions as F

from ledgerline import fixtures
from ledgerline.operators import chunks, profile
from ledgerline.plans import report
from ledgerline.sources import tables as src


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tsv_round_trip(spark, data, tmp_path):
    df = fixtures.noisy_documents(spark, data)
    src.write_tsv(df, str(tmp_path / "t"))
    assert same(src.read_tsv(spark, str(tmp_path / "t"), df.schema), df)
    typed = spark.sql("SELECT 7 AS i, 'a\tb' AS s, 12.5BD AS d, true AS b, TIMESTAMP_NTZ'2026-06-21 17:05:00' AS t, CAST(NULL AS STRING) AS n, X'00FF' AS raw, array(1, 2) AS a")
    lines = src.tsv_lines(typed.drop("raw"))
    assert lines.first().value == "7\ta\\tb\t12.5\t1\t2026-06-21 17:05:00\t\\N\t[1,2]"
    assert src.parse_tsv(lines, typed.drop("raw").schema).first() == typed.drop("raw").first()
    src.write_tsv(df.withColumn("part", F.col("doc_id") % 3), str(tmp_path / "by"), by="part")
    assert sorted(p.name for p in (tmp_path / "by").glob("part=*")) == ["part=0", "part=1", "part=2"]


def test_lines_that_do_not_fit(spark):
    schema = spark.createDataFrame([], "k int, flag boolean, at date").schema
    lines = spark.createDataFrame([("1\tt\t2020-02-29",), ("x\t1\t2020-02-30",), ("2\t\\N\t\\N",), ("3\t1",), ("4\t0\t2020-01-01\tmore",)], "value string")
    got = {r.value: r.bad_columns for r in src.tsv_misfits(lines, schema).collect()}
    assert got == {"x\t1\t2020-02-30": ["k", "at"], "3\t1": ["number of fields"], "4\t0\t2020-01-01\tmore": ["number of fields"]}


def test_record_counts(spark, tmp_path):
    for name, text in {"db.users.0.csv": "1\n2\n3\n", "db.users.1.csv": "4\n5", "db.users_old.0.csv": "1\n", "db.empty.0.csv": "", "db.users.schema.sql": "x\n"}.items():
        (tmp_path / name).write_text(text)
    assert {r.table: r.n_records for r in src.count_records(spark, str(tmp_path)).collect()} == {"users": 5, "users_old": 1}


def test_write_policies(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    src.write_table(rows, path, "insert", ["k"])
    with pytest.raises(ValueError):
        src.write_table(rows, path, "insert", ["k"])
    src.write_table(spark.createDataFrame([(3, "c")], "k int, v string"), path, "insert", ["k"])
    assert spark.read.parquet(path).count() == 3
    src.write_table(spark.createDataFrame([("9", "z")], "k string, v string"), path, "truncate")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(9, "z")]
    src.write_table(spark.createDataFrame([(1.5,)], "x double"), path, "drop")
    assert spark.read.parquet(path).columns == ["x"]


def test_ledger_and_reports(spark, tmp_path):
    work = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "table_name string, chunk long")
    ledger = str(tmp_path / "ledger")
    report.record(ledger, spark.createDataFrame([("a", 0, "completed", 5, 5, 1.0), ("a", 1, "failed", 1, 5, 1.0), ("b", None, "skipped", 0, 0, 0.0)], report.LEDGER_SCHEMA))
    stored = spark.read.parquet(ledger)
    assert [tuple(r) for r in report.pending(work, stored).collect()] == [("a", 1)]
    assert report.pending(work, stored, "truncate").count() == 3
    assert report.load_progress(stored).first().progress == 0.6
    assert report.load_progress(stored.limit(0)).first().progress == 0.0

    def one(table):
        if table == "bad":
            raise ValueError("no such table")
        return spark.createDataFrame([(table, "quick", "pass", 1, 1, 0, None, None)], report.REPORT_SCHEMA)

    got = report.run_tables(spark, ["x", "bad", "y"], one)
    assert [(r.table_name, r.status) for r in got.collect()] == [("x", "pass"), ("bad", "fail"), ("y", "pass")]
    assert report.overall_status(got).first().status == "fail"
    assert report.overall_status(got.filter("status = 'pass'")).first().status == "pass"
    assert report.run_tables(spark, ["bad", "y"], one, on_error="abort").count() == 1


def test_jdbc_round_trip(spark, data, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    region = fixtures.table(spark, data, "nation")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "n_name VARCHAR(60)"}
    src.write_jdbc(region, url, "nation", batch=10, mode="overwrite", **options)
    back = chunks.read_jdbc_partitioned(spark, url, "nation", '"n_nationkey"', 7, {"driver": options["driver"]})
    assert back.rdd.getNumPartitions() == 4
    assert same(back.select(*[F.col(c).alias(c.lower()) for c in back.columns]), region)


def test_catalogs_and_conform(spark, data):
    catalog = src.catalog_of(spark, {"nation": fixtures.table(spark, data, "nation")}, keys={"nation": ["n_nationkey"]})
    assert [(r.column, r.is_primary) for r in catalog.orderBy("position").collect()] == [("n_nationkey", True), ("n_name", False), ("n_regionkey", False)]
    assert src.list_tables(catalog, include=["NATION"]).count() == 3 and src.list_tables(catalog, exclude=["nation"]).count() == 0
    df = spark.createDataFrame([("$1,234.50", "true", "A0-B", "x"), ("?", "maybe", "C", "12")], "m string, b string, u string, n string")
    rows, rejects = profile.conform(df, {"M": "money", "b": "boolean", "u": "uuid"})
    assert [(str(r.m), r.b, r.u) for r in rows.collect()] == [("1234.50", 1, "a0-b")]
    assert [r.bad_columns for r in rejects.collect()] == [["m", "b"]]
    log = spark.createDataFrame([(k, f"ddl {k}") for k in range(5)], "id int, ddl string")
    assert [r.id for r in src.read_ddl_log(log, 2).collect()] == [3, 4] and [r.id for r in src.recent_ddl(log, 2).collect()] == [4, 3]


def test_keys_of_catalogs(spark):
    parts = spark.createDataFrame([("s", "t", "fk", 2, "b", "r", "y"), ("s", "t", "fk", 1, "a", "r", "x")], "schema string, table string, constraint string, position int, column string, ref_table string, ref_column string")
    rules = spark.createDataFrame([("s", "fk", "CASCADE")], "schema string, constraint string, delete_rule string")
    row = profile.foreign_keys(parts, rules).first()
    assert (row.columns, row.ref_columns, row.delete_rule) == (["a", "b"], ["x", "y"], "CASCADE")
    index = spark.createDataFrame([("s", "t", "i", 2, "b"), ("s", "t", "i", 1, "a")], "schema string, table string, index string, position int, column string")
    assert profile.index_columns(index).first().index_columns == ["a", "b"]
