"""Feeds of many tables: what a batch costs, what it counts, and what monitoring finds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import changes as ch
from ledgerline.streaming import feed

BASE = "id int, name string"


def update(lsn, table, key, name, schema="public"):
    cells = [{"name": n, "value": v, "type": "text", "is_key": n == "id", "unchanged": False} for n, v in (("id", str(key)), ("name", name))]
    return (lsn, 0, None, "update", schema, table, cells, None, None)


def batch(spark, rows):
    return ch.decode_changes(spark.createDataFrame(rows, ch.RAW_SCHEMA))


def make(spark, tmp_path, names):
    base = spark.createDataFrame([(1, "a"), (2, "b")], BASE).coalesce(1)
    tables = {name: feed.VersionedTable(spark, str(tmp_path / name), ["id"], buckets=2) for name in names}
    for table in tables.values():
        table.write(base, 0)
    return tables


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_untouched_tables_cost_nothing(spark, tmp_path):
    tables = make(spark, tmp_path, [f"t{k}" for k in range(20)])
    rows = [update(k, f"t{k % 3}", 1, f"n{k}") for k in range(9)]
    spent = {}
    for n in (3, 20):
        some = {name: tables[name] for name in list(tables)[:n]}
        before = jobs(spark)
        feed.apply_batch(some, str(tmp_path / f"state{n}"))(batch(spark, rows), n)
        spent[n] = jobs(spark) - before
    assert spent[3] == spent[20]
    assert [name for name, t in tables.items() if t.versions() != [0]] == ["t0", "t1", "t2"]
    assert [t.versions() for t in list(tables.values())[:3]] == [[4, 21]] * 3
    assert sorted(r.name for r in tables["t1"].read().collect()) == ["b", "n7"]


def test_one_bad_table_stops_the_batch_before_any_is_written(spark, tmp_path):
    tables = make(spark, tmp_path, ["good", "bad"])
    with pytest.raises(ValueError, match="no such column: odd in an event of bad"):
        row = update(2, "bad", 1, "x")
        row[6][1]["name"] = "odd"
        feed.apply_batch(tables, str(tmp_path / "state"))(batch(spark, [update(1, "good", 1, "x"), row]), 0)
    assert [t.versions() for t in tables.values()] == [[0], [0]]


def test_names_with_schemas_and_odd_characters(spark, tmp_path):
    tables = make(spark, tmp_path, ["public.a=b %2f", "a=b %2f", "Ünits"])
    known = spark.createDataFrame([("public", "A=B %2F"), ("other", "a=b %2f"), ("public", "ünits"), ("public", "elsewhere")], "schema string, table string")
    rows = [update(1, "A=b %2F", 1, "one"), update(2, "a=b %2f", 1, "two", "Other"), update(3, "ÜNITS", 1, "three"), update(4, "elsewhere", 1, "x"), update(5, "unheard_of", 1, "x"), update(6, ch.INTERNAL[0], 1, "x")]
    feed.apply_batch(tables, str(tmp_path / "state"), inventory=known)(batch(spark, rows), 0)
    assert [sorted(r.name for r in t.read().collect()) for t in tables.values()] == [["b", "one"], ["b", "two"], ["b", "three"]]
    line = json.loads((tmp_path / "state" / "counters" / "0").read_text())
    assert {k: line[k] for k in ("received", "internal", "applied", "unlisted", "held", "batches", "lsn", "tables")} == {"received": 6, "internal": 1, "applied": 3, "unlisted": 1, "held": 1, "batches": 1, "lsn": 6, "tables": 3}


def test_counters_go_on_and_old_lines_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "KEPT_LINES", 2)
    tables = make(spark, tmp_path, ["t"])
    run = feed.apply_batch(tables, str(tmp_path / "state"))
    run(batch(spark, [update(1, "t", 1, "x"), update(2, "t", 2, "y")]), 0)
    run(batch(spark, [update(3, "t", 1, "z")]).limit(0), 1)
    for _ in range(2):
        run(batch(spark, [update(4, "t", 1, "z")]), 2)
    assert sorted(p.name for p in (tmp_path / "state" / "counters").iterdir() if not p.name.endswith("crc")) == ["1", "2"]
    line = json.loads((tmp_path / "state" / "counters" / "2").read_text())
    assert (line["batches"], line["received"], line["applied"], line["lsn"]) == (3, 3, 3, 4)
    assert tables["t"].versions() == [1, 3]
    assert not [p for p in (tmp_path / "state").iterdir() if p.name.startswith("_")]


def test_metrics_and_liveness_of_a_run(spark, tmp_path):
    tables = make(spark, tmp_path, ["t"])
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    source.mkdir()

    def message(lsn, name):
        cells = [{"name": "id", "value": "1", "type": "int4", "is_key": True}, {"name": name, "value": f"n{lsn}", "type": "text", "is_key": False}]
        return json.dumps({"lsn": lsn, "ordinal": 0, "kind": "UPDATE", "schema": "public", "table": "T", "columns": cells})

    (source / "1.json").write_text("\n".join(message(k, "NAME") for k in range(5)))
    query = feed.start(feed.read_changes(spark, str(source)), tables, checkpoint, available_now=True)
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    metrics = feed.feed_metrics(spark, checkpoint).collect()
    assert [(m.batches, m.lsn, m.lag) for m in metrics] == [(1, 4, 0)] and metrics[0].uptime_seconds > 0 and metrics[0].events_per_second > 0
    assert [r.state for r in feed.feed_state(spark, checkpoint).collect()] == ["stale"]
    # The next run halts: a table has no such column.
    (source / "2.json").write_text(message(9, "colour"))
    query = feed.start(feed.read_changes(spark, str(source)), tables, checkpoint, available_now=True)
    with pytest.raises(Exception, match="no such column: colour"):
        query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sorted(r.state for r in feed.feed_state(spark, checkpoint).collect()) == ["halted", "stale"]
    assert feed.counters(spark, checkpoint).count() == 1
    later = F.timestamp_seconds(F.lit(4_000_000_000))
    assert "stale" in [r.state for r in feed.feed_state(spark, checkpoint, later).collect()]


def test_digests_of_versions_equal_those_of_the_whole(spark, tmp_path):
    from ledgerline.operators.digests import table_digest

    table = feed.VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4, digests={})
    table.write(spark.createDataFrame([(k, f"n{k}") for k in range(30)], BASE), 0)
    run = feed.apply_batch({"t": table}, str(tmp_path / "state"))
    rng = random.Random(4)
    assert table.digest().collect() == table_digest(table.read()).collect()
    for n in range(4):
        rows = []
        for k in range(6):
            row = update(10 * n + k, "t", rng.randrange(40), rng.choice(["x", "y"]))
            kind = rng.choice(["insert", "update", "delete"])
            rows.append((*row[:3], kind, *row[4:6], None, row[6][:1], None) if kind == "delete" else (*row[:3], kind, *row[4:]))
        run(batch(spark, rows), n)
        assert table.digest().collect() == table_digest(table.read()).collect()
    run(batch(spark, [(90, 0, None, "truncate", "public", "t", None, None, None)]), 4)
    assert [r.n_rows for r in table.digest().collect()] == [0] and table.digest().collect() == table_digest(table.read()).collect()
    run(batch(spark, [(*update(91, "t", 5, "z")[:3], "insert", *update(91, "t", 5, "z")[4:])]), 5)
    assert table.digest().collect() == table_digest(table.read()).collect()
    assert sorted(p.name for p in (tmp_path / "t" / "digests").iterdir()) == ["5", "6"]
    with pytest.raises(ValueError, match="no digest"):
        table.digest(1)
    # Other options, or another schema, begin anew.
    other = feed.VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4, digests={"style": "compat"})
    feed.fold_batch(other, batch(spark, [update(99, "t", 5, "w")]), 9)
    assert other.digest().collect() == table_digest(other.read(), style="compat").collect()


def told(lsn, table, ddl):
    return (lsn, 0, None, "ddl", "public", table, None, None, ddl)


def row(lsn, table, kind, key, **cells):
    new = [{"name": n, "value": v, "type": "text", "is_key": n == "id", "unchanged": False} for n, v in {"id": str(key), **cells}.items()]
    return (lsn, 0, None, kind, "public", table, None if kind == "delete" else new, new[:1], None)


def test_columns_change_within_a_batch(spark, tmp_path):
    tables = make(spark, tmp_path, ["t", "u"])
    run = feed.apply_batch(tables, str(tmp_path / "state"))
    rows = [
        row(1, "t", "update", 1, name="before"),
        told(2, "t", 'ALTER TABLE public.t ADD COLUMN "Size" integer, ADD COLUMN tags text[] DEFAULT \'{x,"y,z"}\''),
        row(3, "t", "insert", 3, name="new", size="7"),
        row(4, "t", "update", 2, size="9", tags="{}"),
        told(5, "t", "ALTER TABLE t RENAME name TO label;"),
        row(6, "t", "update", 1, label="after"),
        told(7, "t", "CREATE INDEX i ON t (id)"),
        told(8, "t", "ALTER TABLE t DROP COLUMN tags"),
        row(9, "t", "delete", 3),
        row(10, "u", "update", 1, name="other"),
    ]
    run(batch(spark, rows), 0)
    got = tables["t"].read()
    assert got.columns == ["id", "label", "Size"] and dict(got.dtypes)["Size"] == "int"
    assert sorted(map(tuple, got.collect())) == [(1, "after", None), (2, "b", 9)]
    assert sorted(r.name for r in tables["u"].read().collect()) == ["b", "other"]
    # The old version keeps its schema; later batches know the new one.
    assert tables["t"].read(before=1).columns == ["id", "name"]
    run(batch(spark, [row(11, "t", "insert", 4, label="l", size="1")]), 1)
    assert (4, "l", 1) in list(map(tuple, tables["t"].read().collect()))


def test_a_new_column_leaves_untouched_buckets_alone(spark, tmp_path):
    table = feed.VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=8, digests={})
    table.write(spark.createDataFrame([(k, f"n{k}") for k in range(40)], BASE), 0)
    run = feed.apply_batch({"t": table}, str(tmp_path / "state"))
    run(batch(spark, [told(1, "t", "alter table only t add if not exists more numeric(6,2)"), row(2, "t", "update", 5, more="1.5")]), 0)
    assert len([n for n in table.names("data/1") if n.startswith("_bucket=")]) == 1
    got = {r.id: r.more for r in table.read().collect()}
    assert len(got) == 40 and str(got.pop(5)) == "1.50" and set(got.values()) == {None}
    from ledgerline.operators.digests import table_digest

    assert table.digest().collect() == table_digest(table.read()).collect()


def test_changes_that_cannot_be_followed_stop_the_batch(spark, tmp_path):
    tables = make(spark, tmp_path, ["t", "u"])
    run = feed.apply_batch(tables, str(tmp_path / "state"))
    for ddl, message in [("ALTER TABLE t DROP id", "key column"), ("ALTER TABLE t ADD name text", "already"), ("ALTER TABLE t DROP nothing", "no column nothing"), ("ALTER TABLE t ADD x hyperloglog", "no type here"), ("ALTER TABLE t ALTER COLUMN name TYPE int", "cannot follow")]:
        with pytest.raises(ValueError, match=message):
            run(batch(spark, [told(1, "t", ddl), row(2, "u", "update", 1, name="x")]), 0)
    # An event by the new column before the column is there.
    with pytest.raises(ValueError, match="no such column: size"):
        run(batch(spark, [row(1, "t", "update", 1, size="1"), told(2, "t", "ALTER TABLE t ADD size int")]), 0)
    assert [t.versions() for t in tables.values()] == [[0], [0]]


def test_statements():
    from ledgerline.streaming.alters import parse_alters

    found = parse_alters("ALTER TABLE IF EXISTS \"S\".\"T x\" ADD a varchar(10) DEFAULT 'it''s, (', DROP COLUMN IF EXISTS b CASCADE, ADD CONSTRAINT c CHECK (a > 1), ADD COLUMN \"D\"\"\" timestamp with time zone NOT NULL")
    assert [(c.kind, c.name, c.default, c.lenient) for c in found] == [("add", "a", "it's, (", False), ("drop", "b", None, True), ("add", 'D"', None, False)]
    assert [c.dtype.simpleString() for c in found if c.dtype] == ["string", "timestamp"]
    assert parse_alters("DROP TABLE t") == [] and parse_alters("ALTER TABLE t OWNER TO me") == []
