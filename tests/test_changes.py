"""Change events: the cases of a feed, invariance under batching, moves of keys, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import fixtures
from ledgerline.streaming import changes as ch
from ledgerline.streaming import feed

BASE = "id int, name string, email string"


def cell(name, value, key=False, unchanged=False):
    return {"name": name, "value": value, "type": "text", "is_key": key, "unchanged": unchanged}


def events(spark, rows):
    """rows: (kind, new cells, old cells)."""
    raw = [(k, 0, None, kind, "public", "users", new, old, None) for k, (kind, new, old) in enumerate(rows)]
    return ch.decode_changes(spark.createDataFrame(raw, ch.RAW_SCHEMA))


def state(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def apply(spark, base, rows, **options):
    return state(ch.apply_changes(spark.createDataFrame(base, BASE), events(spark, rows), ["id"], **options))


def test_single_events(spark):
    base = [(1, "Ann", "a@x"), (2, "Bob", None)]
    insert = ("insert", [cell("id", "3", True), cell("name", None), cell("email", "c@x")], None)
    assert apply(spark, base, [insert])[-1] == (3, None, "c@x")
    old_image = ("update", [cell("id", "1", True), cell("name", "Eve")], [cell("id", "1", True), cell("name", "Ann")])
    assert (1, "Eve", "a@x") in apply(spark, base, [old_image])
    unchanged = ("update", [cell("id", "1", True), cell("name", None), cell("email", None, unchanged=True)], None)
    assert (1, None, "a@x") in apply(spark, base, [unchanged])
    assert apply(spark, base, [("delete", None, [cell("id", "2", True), cell("name", "other")])]) == [(1, "Ann", "a@x")]
    assert apply(spark, base, [("truncate", None, None), insert]) == [(3, None, "c@x")]
    assert apply(spark, base, [("update", [cell("id", "9", True), cell("name", "x")], None)]) == base


def test_structural_errors(spark):
    rows = events(spark, [("update", [cell("name", "x")], None), ("delete", None, [cell("name", "x")]), ("update", [cell("id", "1", True, unchanged=True)], [cell("id", "1", True)]), ("insert", [cell("id", "1", True)], None)])
    good, rejects = ch.reject_structural(rows)
    assert [r.kind for r in good.collect()] == ["insert"]
    assert sorted(r.reason for r in rejects.collect()) == ["no column to set", "no key", "no key"]


def replay(base, rows, strategy):
    """The feed one event at a time."""
    table = {r[0]: dict(zip(("id", "name", "email"), r)) for r in base}
    for kind, new, old in rows:
        cells = {c["name"]: c["value"] for c in new or [] if not c["unchanged"]}
        key = int(next(c["value"] for c in [*(old or []), *(new or [])] if c["is_key"]))
        if kind == "insert":
            if key not in table or strategy == "replace":
                table[key] = {"id": key, "name": cells.get("name"), "email": cells.get("email")}
            elif strategy == "upsert":
                table[key] |= {c: v for c, v in cells.items() if c != "id"}
        elif kind == "update" and key in table:
            table[key] |= {c: v for c, v in cells.items() if c != "id"}
        elif kind == "delete":
            table.pop(key, None)
    return sorted((tuple(r.values()) for r in table.values()), key=repr)


def random_feed(rng, n):
    rows = []
    for _ in range(n):
        key = cell("id", str(rng.randrange(6)), True)
        extra = [cell(c, rng.choice(["p", "q", None])) for c in ("name", "email") if rng.random() < 0.6]
        kind = rng.choice(["insert", "update", "update", "delete"])
        rows.append((kind, None, [key]) if kind == "delete" else (kind, [key, *extra], None))
    return rows


@pytest.mark.parametrize("strategy", ch.STRATEGIES)
def test_random_feeds_against_replay(spark, strategy):
    base = [(k, f"n{k}", f"e{k}") for k in range(3)]
    for seed in range(3):
        rows = random_feed(random.Random(seed), 40)
        assert apply(spark, base, rows, on_conflict=strategy) == replay(base, rows, strategy)


def test_batches_do_not_matter(spark, data):
    base, changes = fixtures.table(spark, data, "orders"), fixtures.order_feed(spark, data)
    whole = state(ch.apply_changes(base, changes, ["o_orderkey"]))
    middle = 10 * base.agg(F.max("o_orderkey")).first()[0] // 2 + 1
    half = ch.apply_changes(base, changes.filter(F.col("lsn") <= middle), ["o_orderkey"])
    assert state(ch.bootstrap(half, changes, ["o_orderkey"], middle)) == whole
    again = ch.apply_changes(ch.apply_changes(base, changes, ["o_orderkey"]), changes, ["o_orderkey"])
    assert state(again.filter("o_orderkey % 10 <> 7")) == state(ch.apply_changes(base, changes, ["o_orderkey"]).filter("o_orderkey % 10 <> 7"))


def move(a, b, **more):
    return ("update", [cell("id", str(b), True), *[cell(k, v) for k, v in more.items()]], [cell("id", str(a), True)])


def test_moved_keys(spark):
    base = [(1, "Ann", "a"), (2, "Bob", "b"), (5, "Eve", "e")]
    rows = [move(1, 3, name="Moved"), move(2, 1), ("update", [cell("id", "3", True), cell("email", "new")], None), move(3, 4), ("delete", None, [cell("id", "1", True)]), ("update", [cell("id", "5", True), cell("name", "Five")], None)]
    assert apply(spark, base, rows) == [(4, "Moved", "new"), (5, "Five", "e")]
    # A row that is there gives way; a move of nothing does nothing.
    assert apply(spark, base, [move(1, 2), move(9, 5, name="x")]) == [(2, "Ann", "a"), (5, "Eve", "e")]
    assert apply(spark, base, [move(1, 7), ("truncate", None, None), move(2, 8), ("insert", [cell("id", "3", True)], None), move(3, 4)]) == [(4, None, None)]


def replay_moves(base, rows, strategy):
    """``replay`` where updates may change the key."""
    table = {r[0]: dict(zip(("id", "name", "email"), r)) for r in base}
    for kind, new, old in rows:
        cells = {c["name"]: c["value"] for c in new or [] if not c["unchanged"]}
        key = int(next(c["value"] for c in [*(old or []), *(new or [])] if c["is_key"]))
        if kind == "insert":
            if key not in table or strategy == "replace":
                table[key] = {"id": key, "name": cells.get("name"), "email": cells.get("email")}
            elif strategy == "upsert":
                table[key] |= {c: v for c, v in cells.items() if c != "id"}
        elif kind == "update" and key in table:
            row = table.pop(key) | {c: v for c, v in cells.items() if c != "id"}
            row["id"] = int(cells["id"])
            table[row["id"]] = row
        elif kind == "delete":
            table.pop(key, None)
    return sorted((tuple(r.values()) for r in table.values()), key=repr)


@pytest.mark.parametrize("strategy", ch.STRATEGIES)
def test_random_moves_against_replay(spark, strategy):
    base = [(k, f"n{k}", f"e{k}") for k in range(4)]
    rng = random.Random(strategy)
    rows = random_feed(rng, 40)
    for _ in range(50):
        more = {c: rng.choice(["p", "q", None]) for c in ("name", "email") if rng.random() < 0.5}
        rows.insert(rng.randrange(len(rows)), move(rng.randrange(7), rng.randrange(7), **more))
    assert apply(spark, base, rows, on_conflict=strategy) == replay_moves(base, rows, strategy)


@pytest.mark.parametrize("step", [1, -1])
def test_every_key_moves_on_by_one(spark, step):
    """``id = id + 1`` over 100,000 rows; in one order each row leaves before the next arrives, in the other each is overwritten."""
    n = 100_000
    base = spark.range(n).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("e").alias("email"))
    at = F.col("id") if step == 1 else F.lit(n) - F.col("id")
    feed_ = base.select(
        at.cast("long").alias("lsn"), F.lit(0).alias("ordinal"), F.lit(None).cast("timestamp").alias("ts"), F.lit("update").alias("kind"), F.lit("public").alias("schema"), F.lit("users").alias("table"),
        F.create_map(F.lit("id"), F.col("id").cast("string")).alias("key"), F.create_map(F.lit("id"), (F.col("id") + 1).cast("string")).alias("new"), F.array(F.lit("id")).alias("set_cols"), F.lit(None).cast("string").alias("ddl"),
    )
    got = ch.apply_changes(base, feed_, ["id"])
    if step == 1:
        assert state(got) == [(n, "n0", "e")]
    else:
        row = got.agg(F.count("*"), F.min("id"), F.max("id"), F.count_if(F.col("name") != F.concat(F.lit("n"), F.col("id") - 1)), F.count_distinct("id")).first()
        assert tuple(row) == (n, 1, n, 0, n)


def test_misfits(spark):
    schema = spark.createDataFrame([], "id int, name string, flag boolean, price decimal(6,2)").schema
    rows = events(spark, [
        ("insert", [cell("id", "1", True), cell("flag", "t"), cell("price", "1.5"), cell("other", "x")], None),
        ("update", [cell("id", "1", True), cell("flag", "maybe"), cell("price", "n/a")], None),
        ("delete", None, [cell("id", "one", True)]),
        ("update", [cell("id", "1", True), cell("price", None)], None),
    ])
    good, bad = ch.reject_misfits(rows, schema)
    assert sorted(r.lsn for r in good.collect()) == [0, 3]
    assert sorted(r.reason for r in bad.collect()) == ["value does not fit: flag, price", "value does not fit: id"]


def test_globs_and_filters(spark):
    names = spark.createDataFrame([("public", "a_log"), ("public", "a_log_x"), ("audit", "b"), ("public", "users")], "schema string, table string")
    kept = lambda **kw: sorted(r.table for r in ch.table_filter(names, **kw).collect())
    assert kept(include=("*_log",)) == ["a_log"]
    assert kept(include=("*_log",), compat=True) == ["a_log", "a_log_x"]
    assert kept(exclude=("public.a*",), exclude_schemas=("audit",)) == ["users"]
    assert kept(include_schemas=("aud*",)) == ["b"]
    assert kept() == ["a_log", "a_log_x", "b", "users"]


@pytest.mark.parametrize("files", [1, 3, 7])
def test_stream_reaches_the_batch_state(spark, data, tmp_path, files):
    base, changes = fixtures.table(spark, data, "orders"), fixtures.order_feed(spark, data)
    expected = state(ch.apply_changes(base, changes, ["o_orderkey"]))
    rows = changes.orderBy("lsn", "ordinal").collect()
    source = tmp_path / "in"
    source.mkdir()
    size = -(-len(rows) // files)
    for f in range(files):
        lines = []
        for r in rows[f * size : (f + 1) * size]:
            keys = [cell(k, v, True) for k, v in r.key.items()]
            new = [cell(k, v) for k, v in r.new.items() if k not in r.key]
            lines.append(json.dumps({"lsn": r.lsn, "ordinal": r.ordinal, "kind": r.kind, "schema": "public", "table": "orders", "columns": None if r.kind == "delete" else keys + new, "old_columns": keys}))
        (source / f"{f:03}.json").write_text("\n".join(lines))
        import os

        os.utime(source / f"{f:03}.json", (1_700_000_000 + f, 1_700_000_000 + f))
    table = feed.VersionedTable(spark, str(tmp_path / "table"), ["o_orderkey"], buckets=8)
    table.write(base, 0)
    stream = feed.read_changes(spark, str(source), files_per_trigger=1)
    known = spark.createDataFrame([("public", "orders")], "schema string, table string")
    for _ in range(2):
        query = feed.start(stream, {"orders": table}, str(tmp_path / "checkpoint"), available_now=True, inventory=known)
        query.awaitTermination()
    assert table.versions() == list(range(files + 1))[-2:]
    got = table.read().select(*base.columns)
    # Keys sent in the new image are set as they were.
    assert state(got) == expected


def test_unknown_tables_wait_and_bad_events_stop(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "b")], BASE)
    table = feed.VersionedTable(spark, str(tmp_path / "users"), ["id"], buckets=4)
    table.write(base, 0)
    known = spark.createDataFrame([("public", "other")], "schema string, table string")
    row = events(spark, [("update", [cell("id", "1", True), cell("name", "late")], None)])
    held = str(tmp_path / "state")
    feed.apply_batch({"users": table}, held, inventory=known)(row, 0)
    assert state(table.read()) == [(1, "a", "b")]
    # A new process finds what the last one held back.
    feed.apply_batch({"users": table}, held, inventory=known)(row.limit(0), 1)
    both = spark.createDataFrame([("public", "users")], "schema string, table string").union(known)
    later = feed.apply_batch({"users": table}, held, inventory=both)
    later(row.limit(0), 2)
    assert state(table.read()) == [(1, "late", "b")]
    # A batch that runs again changes nothing, also if the inventory is another by then.
    feed.apply_batch({"users": table}, held, inventory=known)(row.limit(0), 2)
    later(row.limit(0), 3)
    # Batches without events of the table make no version of it.
    assert state(table.read()) == [(1, "late", "b")] and table.versions() == [0, 3]
    with pytest.raises(ValueError, match="no key"):
        later(events(spark, [("update", [cell("name", "x")], None)]), 4)
    with pytest.raises(ValueError, match="does not fit: id"):
        later(events(spark, [("insert", [cell("id", "one", True)], None)]), 4)
    assert table.versions()[-1] == 3
    other = feed.apply_batch({"users": table}, held, inventory=known, max_held=3)
    other(row, 5)
    with pytest.raises(ValueError, match="waited"):
        for k in range(6, 12):
            other(row.limit(0), k)


def test_many_tables_moves_and_files_that_stay(spark, tmp_path):
    """Two tables in one feed of small batches: each equals its replay, and a batch writes the buckets it touches."""
    base = [(k, f"n{k}", f"e{k}") for k in range(40)]
    tables = {name: feed.VersionedTable(spark, str(tmp_path / name), ["id"], buckets=16) for name in ("users", "public.shops")}
    for table in tables.values():
        table.write(spark.createDataFrame(base, BASE), 0)
    run = feed.apply_batch(tables, str(tmp_path / "state"))
    rng, all_rows = random.Random(5), {"users": [], "shops": []}
    for batch in range(4):
        raw = []
        for k in range(6):
            name = rng.choice(["users", "shops"])
            a, b = rng.randrange(45), rng.randrange(45)
            event = rng.choice([move(a, b, name=f"m{batch}{k}"), ("delete", None, [cell("id", str(a), True)]), ("insert", [cell("id", str(a), True), cell("name", "i")], None)])
            all_rows[name].append(event)
            raw.append((100 * batch + k, 0, None, event[0], "public", name, event[1], event[2], None))
        run(ch.decode_changes(spark.createDataFrame(raw, ch.RAW_SCHEMA)), batch)
        for name, table in zip(("users", "shops"), tables.values()):
            assert state(table.read()) == replay_moves(base, all_rows[name], "replace")
    table = tables["users"]
    written = {n for n in table.names("data/4") if n.startswith("_bucket=")} if "4" in table.names("data") else set()
    assert len(written) < 16 and table.versions() == [3, 4]
    truncate = ch.decode_changes(spark.createDataFrame([(900, 0, None, "truncate", "public", "users", None, None, None)], ch.RAW_SCHEMA))
    run(truncate, 4)
    assert state(table.read()) == [] and state(tables["public.shops"].read()) == replay_moves(base, all_rows["shops"], "replace")


def test_a_hot_moved_key_lies_in_many_parts(spark):
    rng = random.Random(9)
    rows = [("hot", k, 0, rng.choice(["set"] * 30 + ["insert", "out"])) for k in range(6000)] + [("hot", 10_000 + k, 0, "set") for k in range(3000)] + [(f"k{rng.randrange(40)}", k, 1, rng.choice(["set", "set", "delete"])) for k in range(1000)]
    steps = spark.createDataFrame(rows, "key string, lsn long, ordinal int, kind string").select("key", F.struct("lsn", "ordinal").alias("at"), "kind")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ch.with_previous(steps).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    ids = {(r.key, r["at"]["lsn"], r["at"]["ordinal"]): r.id for r in got}
    last, expected = {}, {}
    for key, lsn, ordinal, kind in sorted(rows):
        expected[key, lsn, ordinal] = last.get(key)
        if kind != "set":
            last[key] = ids[key, lsn, ordinal]
    assert {(r.key, r["at"]["lsn"], r["at"]["ordinal"]): r.prev for r in got} == expected
    sizes = {}
    for r in got:
        sizes[r.part] = sizes.get(r.part, 0) + 1
    assert len(sizes) > 8 and max(sizes.values()) < 3 * len(rows) / 16
    assert sum(r.key == "hot" for r in got) == 9000 and len({r.part for r in got if r.key == "hot"}) > 8


def test_moves_of_a_key_with_many_events_against_replay(spark):
    rng = random.Random(11)
    rows = []
    for k in range(400):
        rows.append(("update", [cell("id", "1", True), cell("name", f"n{k}")], None))
        if k % 97 == 5:
            rows += [move(1, 2), move(2, 1)]
    rows += [move(rng.randrange(4), rng.randrange(4), email=f"e{k}") for k in range(20)]
    base = [(1, "a", "b"), (3, "c", "d")]
    assert apply(spark, base, rows) == replay_moves(base, rows, "replace")


def test_monitoring(spark):
    beats = spark.sql(
        "SELECT * FROM VALUES (false, true, TIMESTAMP'2024-01-01 00:00:50'), (false, true, TIMESTAMP'2024-01-01 00:00:10'), (false, false, TIMESTAMP'2024-01-01 00:00:50'), (true, true, TIMESTAMP'2024-01-01 00:00:00'), (false, true, NULL) AS t(halted, process_alive, updated)"
    )
    got = [r.state for r in feed.liveness(beats, F.lit("2024-01-01 00:01:00").cast("timestamp")).collect()]
    assert got == ["running", "stale", "stale", "halted", "not_running"]
    counters = spark.createDataFrame([(10, 4, 0, 2), (3, 5, 1, 1)], "received long, applied long, started long, now long")
    assert [(r.lag, r.events_per_second) for r in feed.stream_metrics(counters).collect()] == [(6, 2.0), (0, None)]
