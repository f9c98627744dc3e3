"""Change events: decoding, checks, and folding them into a base table.

The end state of a key needs no replay. Which event last made or removed its row, and which event last
set each column, are maxima over the order of events; so one grouping with map-side combining folds a
change feed, however many events a key has. Updates that change keys are resolved first: every row gets
a number that stays with it from key to key, and its events are folded under that number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.decode import bytes_text, decode_value
from ledgerline.operators.skew import split_join
from ledgerline.session import stored

CELL = "array<struct<name:string,value:string,type:string,is_key:boolean,unchanged:boolean>>"
RAW_SCHEMA = f"lsn bigint, ordinal int, ts timestamp, kind string, schema string, table string, columns {CELL}, old_columns {CELL}, ddl string"
#: ``types``, the source type of each value, may be left out.
EVENT_SCHEMA = "lsn bigint, ordinal int, ts timestamp, kind string, schema string, table string, key map<string,string>, new map<string,string>, set_cols array<string>, ddl string, types map<string,string>"
ROW_KINDS = ("insert", "update", "delete")
STRATEGIES = ("replace", "insert_ignore", "upsert", "skip")
#: Reserved bookkeeping tables, never applied; a deployment adds its own with ``skip``.
INTERNAL = ("_ledgerline_ddl_log",)


def decode_changes(raw: DataFrame) -> DataFrame:
    """Events of RAW_SCHEMA as EVENT_SCHEMA.

    The key comes from the old image where it has key columns, else from the new one. Columns marked
    unchanged are in neither new nor set_cols; a NULL that was set is in both.
    """
    def keys(image: str) -> Column:
        return F.filter(F.coalesce(F.col(image), F.expr(f"cast(array() as {CELL})")), lambda c: c["is_key"] & ~F.coalesce(c["unchanged"], F.lit(False)))

    def as_map(cells: Column, what: str = "value") -> Column:
        return F.map_from_entries(F.transform(cells, lambda c: F.struct(c["name"].alias("key"), c[what].alias("value"))))

    old = F.when(F.size(keys("old_columns")) > 0, keys("old_columns")).otherwise(keys("columns"))
    typed = F.filter(F.coalesce(F.col("columns"), F.expr(f"cast(array() as {CELL})")), lambda c: c["type"].isNotNull())
    more = F.filter(old, lambda c: c["type"].isNotNull() & ~F.exists(typed, lambda t: t["name"] == c["name"]))
    present = F.filter(F.coalesce(F.col("columns"), F.expr(f"cast(array() as {CELL})")), lambda c: ~F.coalesce(c["unchanged"], F.lit(False)))
    return raw.select(
        "lsn",
        F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        "ts",
        F.lower("kind").alias("kind"),
        "schema",
        "table",
        as_map(old).alias("key"),
        as_map(present).alias("new"),
        F.transform(present, lambda c: c["name"]).alias("set_cols"),
        "ddl",
        as_map(F.concat(typed, more), "type").alias("types"),
    )


def structural_reason() -> Column:
    """Why an event cannot be applied to any table: an update or delete has no key, or an update sets nothing. NULL if it can."""
    no_key = F.col("kind").isin("update", "delete") & (F.coalesce(F.size("key"), F.lit(0)) < 1)
    nothing = (F.col("kind") == "update") & (F.coalesce(F.size("set_cols"), F.lit(0)) < 1)
    return F.when(no_key, "no key").when(nothing, "no column to set")


def reject_structural(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): an update that sets nothing, and an update or delete without a key, cannot be applied.

    rejects carry a column reason. A caller halts where there are any.
    """
    return events.filter(structural_reason().isNull()), events.withColumn("reason", structural_reason()).filter("reason IS NOT NULL")


def split_known_tables(events: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, held): events of tables outside of the inventory (schema, table) are held back for a later batch."""
    known = inventory.select(F.lower("schema").alias("_s"), F.lower("table").alias("_t")).distinct()
    same = (F.lower(events["schema"]) == F.col("_s")) & (F.lower(events["table"]) == F.col("_t"))
    return events.join(known, same, "left_semi"), events.join(known, same, "left_anti")


def drop_internal(events: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Events without those of reserved and skipped tables, whose names are told without regard to case."""
    return events.filter(~F.lower("table").isin(*INTERNAL, *[t.lower() for t in skip]))


def truncate_cutoff(events: DataFrame) -> DataFrame:
    """schema, table, cutoff: position of the last truncate of each table."""
    return events.filter("kind = 'truncate'").groupBy("schema", "table").agg(F.max(F.struct("lsn", "ordinal")).alias("cutoff"))


def after_truncate(events: DataFrame) -> DataFrame:
    """Row events that no later truncate of their table wipes out."""
    rows = events.filter(F.col("kind").isin("insert", "update", "delete"))
    cut = truncate_cutoff(events).withColumnRenamed("schema", "_s").withColumnRenamed("table", "_t")
    same = rows["schema"].eqNullSafe(F.col("_s")) & rows["table"].eqNullSafe(F.col("_t"))
    return rows.join(cut, same, "left").filter(F.col("cutoff").isNull() | (F.struct("lsn", "ordinal") > F.col("cutoff"))).select(*rows.columns)


def _spelling(name: Column, schema: T.StructType) -> Column:
    """The name of the column that is meant: the name itself, or the only one that differs from it by case alone; else the name as it is."""
    by_case: dict[str, list[str]] = {}
    for n in schema.names:
        by_case.setdefault(n.lower(), []).append(n)
    lone = [x for low, names in by_case.items() if len(names) == 1 for x in (F.lit(low), F.lit(names[0]))]
    found = F.create_map(*lone)[F.lower(name)] if lone else F.lit(None).cast("string")
    return F.when(name.isin(*schema.names), name).otherwise(F.coalesce(found, name))


def _conformed(events: DataFrame, schema: T.StructType) -> dict[str, Column]:
    """key, new and set_cols of events of one table in the spelling of its schema, and byte strings as ``decode_value`` takes them."""
    binary = [f.name for f in schema.fields if isinstance(f.dataType, T.BinaryType)]

    def spelled(name: str) -> Column:
        image = F.col(name)
        if binary and "types" in events.columns:
            image = F.transform_values(image, lambda c, v: F.when(_spelling(c, schema).isin(*binary), bytes_text(v, F.col("types")[c])).otherwise(v))
        lone = F.size(F.array_distinct(F.transform(F.map_keys(name), lambda c: _spelling(c, schema)))) == F.size(name)
        return F.when(lone, F.transform_keys(image, lambda c, _: _spelling(c, schema))).otherwise(image)

    return {"key": spelled("key"), "new": spelled("new"), "set_cols": F.array_distinct(F.transform("set_cols", lambda c: _spelling(c, schema)))}


def _with_conformed(events: DataFrame, schema: T.StructType, prefix: str = "") -> DataFrame:
    # By a generator, through which filters and projections do not multiply the expressions.
    told = F.struct(*[c.alias(f"{prefix}{name}") for name, c in _conformed(events, schema).items()])
    return events.select(*[c for c in events.columns if prefix or c not in ("key", "new", "set_cols")], F.inline(F.array(told)))


def conform_events(events: DataFrame, schema: T.StructType) -> DataFrame:
    """Events of one table with column names as its schema spells them: exactly if there is such a column, else without regard to case.

    An image that has two names for one column is left as it is, so that only exact names count.
    """
    return _with_conformed(events, schema).select(*events.columns)


def resolve(schema: T.StructType, names: list[str]) -> list[str]:
    """Columns as the schema spells them."""
    out = []
    for name in names:
        found = [n for n in schema.names if n == name] or [n for n in schema.names if n.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"no column {name!r}" if not found else f"{name!r} may be {' or '.join(found)}")
        out += found
    return out


def _has_keys(keys: list[str]) -> Column:
    """Whether a row event has a value, or NULL, for each key column."""
    def has(image: str, k: str) -> Column:
        return F.coalesce(F.map_contains_key(image, k), F.lit(False))

    return reduce(lambda a, b: a & b, [has("key", k) | ((F.col("kind") == "insert") & has("new", k)) for k in keys])


def reject_misfits(events: DataFrame, schema: T.StructType, keys: list[str] | None = None, max_length: int = 0) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): row events that ``apply_changes`` applies without loss, and those that it does not.

    rejects carry a column reason: values that do not fit their column's type. If ``keys`` are given, also columns that the table
    does not have, which are ignored else, and key columns that an event lacks. Other events, as truncates, are good.
    """
    judged = _with_conformed(events, schema, "_")
    reason = misfit_reason(schema, keys, max_length, "_")
    judged = judged.select(*events.columns, F.explode(F.array(reason)).alias("reason")).withColumn("reason", F.nullif("reason", F.lit("")))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def misfit_reason(schema: T.StructType, keys: list[str] | None = None, max_length: int = 0, prefix: str = "") -> Column:
    """Why a conformed event (columns key, new and set_cols, with the prefix) does not fit a table; empty or NULL if it does."""
    key, new, set_cols = (f"{prefix}{name}" for name in ("key", "new", "set_cols"))

    def bad(f: T.StructField, cells: str) -> Column:
        cell = F.col(cells)[f.name]
        return cell.isNotNull() & decode_value(cell, f.dataType, max_length).isNull()

    def listed(what: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(what), F.array_join(names, ", ")))

    none = F.array().cast("array<string>")
    fields = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    misfits = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(bad(f, new) | bad(f, key), f.name) for f in fields]))
    lacking = unknown = none
    if keys:
        keys = resolve(schema, keys)
        given = F.array_distinct(F.concat(F.coalesce(F.map_keys(key), none), F.coalesce(F.map_keys(new), none), F.coalesce(set_cols, none)))
        unknown = F.array_sort(F.filter(given, lambda n: ~n.isin(*schema.names)))
        has = {k: F.coalesce(F.map_contains_key(key, k), F.lit(False)) | ((F.col("kind") == "insert") & F.coalesce(F.map_contains_key(new, k), F.lit(False))) for k in keys}
        lacking = F.array_compact(F.array(*[F.when(~h, k) for k, h in has.items()]))
    reasons = [listed("value does not fit: ", misfits), listed("no such column: ", unknown), listed("no value for key column: ", lacking)]
    return F.when(F.col("kind").isin(*ROW_KINDS), F.concat_ws("; ", *reasons))


def _key_text(cells: list[Column], fields: list[T.StructField]) -> Column:
    texts = [F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string") for c, f in zip(cells, fields, strict=True)]
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\\N")) for c in texts])


def row_text(df: DataFrame, keys: list[str]) -> Column:
    """The text ``apply_changes`` joins on: key values as Spark renders them, bytes in hex."""
    keys = resolve(df.schema, keys)
    return _key_text([df[k] for k in keys], [df.schema[k] for k in keys])


def event_keys(events: DataFrame, schema: T.StructType, keys: list[str], max_length: int = 0) -> DataFrame:
    """Row events in the spelling of the schema, with the text of their key, ``row_key``, and of the key an update leaves the row at, ``to_key``.

    ``own`` and ``to`` hold the same as typed values. Inserts take their key from the new image. Events that lack a key column are left out.
    """
    keys = resolve(schema, keys)
    return with_keys(conform_events(events, schema).filter(_has_keys(keys)), schema, keys, max_length)


def with_keys(events: DataFrame, schema: T.StructType, keys: list[str], max_length: int = 0) -> DataFrame:
    """The columns of ``event_keys`` for conformed events."""
    fields = {f.name: f for f in schema.fields}
    own = {k: F.coalesce(F.col("key")[k], F.when(F.col("kind") == "insert", F.col("new")[k])) for k in keys}
    to = {k: F.when((F.col("kind") == "update") & F.array_contains("set_cols", k), F.col("new")[k]).otherwise(own[k]) for k in keys}
    typed = {name: F.struct(*[decode_value(c, fields[k].dataType, max_length).alias(k) for k, c in cells.items()]).alias(name) for name, cells in (("own", own), ("to", to))}
    events = events.select("*", *typed.values())
    texts = [_key_text([F.col(name)[k] for k in keys], [fields[k] for k in keys]).alias(alias) for name, alias in (("own", "row_key"), ("to", "to_key"))]
    return events.select("*", *texts)


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], on_conflict: str = "replace", max_length: int = 0, held: Row | None = None) -> DataFrame:
    """``base`` after all row events of one table, in order of (lsn, ordinal), which is unique.

    insert makes the row, update sets the columns it has, delete removes the row; an update or delete of
    an absent row does nothing. Where an insert meets a row: replace takes the new row, insert_ignore and
    skip keep the old one, upsert overwrites the columns given. A truncate empties the table. An update that
    changes the key moves the row, and takes the place of a row that is there.

    Column names are told without regard to case where that is unambiguous. Values are decoded by the types of
    the source and of the column (``decode_value``); texts are cut to max_length characters unless that is 0. Values that do not fit
    become NULL, columns that the table does not have are ignored, and events that lack a key column do nothing: ``reject_misfits`` finds all
    of them. The feed is read once to see what it holds, unless ``held`` (see ``holdings``) says it, and once to fold it.
    """
    if on_conflict not in STRATEGIES:
        raise ValueError(f"unknown strategy {on_conflict!r}; known are {', '.join(STRATEGIES)}")
    schema, keys = base.schema, resolve(base.schema, keys)
    held = held or conform_events(changes, schema).agg(*holdings(keys)).first()
    left = after_truncate(changes) if held.truncates else changes.filter(F.col("kind").isin(*ROW_KINDS))
    events = event_keys(left, schema, keys, max_length)
    events = events.withColumn("at", F.struct("lsn", "ordinal")).select("row_key", "to_key", "own", "to", "at", "kind", "new", "set_cols")
    kept = base.limit(0) if held.truncates else base
    rows = kept.select(F.struct("*").alias("b"), row_text(kept, keys).alias("_bk"))
    if not held.moves:
        return _fold(rows, events, schema, keys, on_conflict, held.n, max_length).drop("_id")
    return _fold_moved(rows, events, schema, keys, on_conflict, held.n, max_length)


MOVES = "kind = 'update' AND row_key <> to_key"


def holdings(keys: list[str]) -> list[Column]:
    """Aggregates over conformed events of one table: how many truncates and row events there are, and how many updates that set a key column anew."""
    differs = reduce(lambda a, b: a | b, [F.array_contains("set_cols", k) & ~F.col("new")[k].eqNullSafe(F.col("key")[k]) for k in keys])
    return [F.count_if(F.col("kind") == "truncate").alias("truncates"), F.count_if(F.col("kind").isin(*ROW_KINDS)).alias("n"), F.count_if((F.col("kind") == "update") & differs).alias("moves")]


def _births(events: DataFrame, total: int) -> DataFrame:
    """row_key, gone (position of the last delete), born and birth (position and image of the first insert after it)."""
    ends = events.groupBy("row_key").agg(F.max(F.when(F.col("kind") == "delete", F.col("at"))).alias("gone"), F.count(F.lit(1)).alias("n"))
    inserts = events.filter("kind = 'insert'").select("row_key", "at", "new")
    later = split_join(inserts, ends, "row_key", total).filter(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    return later.groupBy("row_key").agg(F.min("at").alias("born"), F.min_by("new", "at").alias("birth"))


def _fold(rows: DataFrame, events: DataFrame, schema: T.StructType, keys: list[str], on_conflict: str, total: int, max_length: int = 0) -> DataFrame:
    """Rows (struct b, key text _bk) after events that move none, and ``_id``, the key text of each row."""
    fields = [f for f in schema.fields if f.name not in keys]
    insert, update = F.col("kind") == "insert", F.col("kind") == "update"
    kinds = update | insert if on_conflict == "upsert" else update
    own = F.first("own", ignorenulls=True).alias("own")
    sets = [F.max_by(F.struct("at", F.col("new")[f.name].alias("value")), F.when(kinds & F.array_contains("set_cols", f.name), F.col("at"))).alias(f"_u_{f.name}") for f in fields]
    if on_conflict == "replace":
        reset = F.when(~update, F.col("at"))
        folded = events.groupBy("row_key").agg(own, F.max(reset).alias("reset"), F.max_by(F.struct("kind", "new"), reset).alias("last"), *sets)
    else:
        # Events before the row's birth in the feed do nothing, unless the base row lives on.
        folded = events.groupBy("row_key").agg(own, F.max(F.when(F.col("kind") == "delete", F.col("at"))).alias("gone"), *sets).join(_births(events, total), "row_key", "left")
    both = rows.join(folded, F.col("_bk") == F.col("row_key"), "full_outer")
    was = F.col("b").isNotNull()
    touched = F.col("row_key").isNotNull()
    if on_conflict == "replace":
        made = F.coalesce(F.col("last.kind") == "insert", F.lit(False))
        wiped = F.coalesce(F.col("last.kind") == "delete", F.lit(False))
        exists = F.when(made, True).when(wiped, False).otherwise(was)
        from_new = F.col("last.new")
        newer = {f.name: F.col(f"_u_{f.name}").isNotNull() & (F.col("reset").isNull() | (F.col(f"_u_{f.name}")["at"] > F.col("reset"))) for f in fields}
    else:
        lives = was & F.col("gone").isNull()
        made = ~lives & F.col("born").isNotNull()
        exists = lives | made
        from_new = F.col("birth")
        newer = {f.name: F.col(f"_u_{f.name}").isNotNull() & (lives | (F.col(f"_u_{f.name}")["at"] >= F.col("born"))) for f in fields}
    columns = []
    for f in schema.fields:
        if f.name in keys:
            columns.append(F.when(was, F.col("b")[f.name]).otherwise(F.col("own")[f.name]).alias(f.name))
        else:
            value = F.when(newer[f.name], decode_value(F.col(f"_u_{f.name}")["value"], f.dataType, max_length)).when(made, decode_value(from_new[f.name], f.dataType, max_length)).otherwise(F.col("b")[f.name])
            columns.append(F.when(touched, value).otherwise(F.col("b")[f.name]).alias(f.name))
    return both.filter(F.coalesce(F.when(touched, exists).otherwise(was), F.lit(False))).select(*columns, F.coalesce("_bk", "row_key").alias("_id"))


def _timeline(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Stored steps of each key, numbered (id), with the step before (prev; plain updates are passed over).

    kind is base, insert, delete, out (the row is moved to another key), in (one is moved here) or set.
    """
    start = F.struct(F.lit(-(1 << 63)).cast("bigint").alias("lsn"), F.lit(0).alias("ordinal"))
    nothing = [F.lit(None).cast("map<string,string>").alias("new"), F.lit(None).cast("array<string>").alias("set_cols")]
    move = F.expr(MOVES)
    kind = F.when(move, "out").when(F.col("kind") == "update", "set").otherwise(F.col("kind")).alias("kind")
    steps = (
        rows.select(F.col("_bk").alias("key"), "own", start.alias("at"), F.lit("base").alias("kind"), *nothing)
        .union(events.select(F.col("row_key").alias("key"), "own", "at", kind, *[F.when(~move, F.col(c)).alias(c) for c in ("new", "set_cols")]))
        .union(events.filter(move).select(F.col("to_key").alias("key"), F.col("to").alias("own"), "at", F.lit("in").alias("kind"), "new", "set_cols"))
    )
    return stored(with_previous(steps).select("id", *steps.columns, "prev"))


def with_previous(steps: DataFrame) -> DataFrame:
    """Steps (key, at, kind and more) with ``id``, ``part``, and ``prev``: the id of the key's last step before that is no plain update.

    A prefix scan in two levels: steps are dealt out by ranges of key and position, so that a key with very many steps lies in
    many parts. Within a part a window looks back; what lies before the part is told by the parts' last steps, of which there
    is one a part.
    """
    ordered = steps.repartitionByRange("key", "at").sortWithinPartitions("key", "at").withColumn("id", F.monotonically_increasing_id())
    # Stored, as ranges are cut by a sample: planned twice they would be cut in two ways.
    rows = stored(ordered.withColumn("part", F.shiftright("id", 33)))
    within = Window.partitionBy("part", "key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("kind") != "set"
    parts = rows.groupBy("part").agg(F.min_by("key", "id").alias("head"), F.max_by("key", "id").alias("tail"), F.max(F.when(end, F.struct("id", "key"))).alias("end"))
    tails = parts.select("part", F.col("tail").alias("key"), F.when(F.col("end.key") == F.col("tail"), F.col("end.id")).alias("left"), F.lit(1).alias("place"))
    heads = parts.select("part", F.col("head").alias("key"), F.lit(None).cast("bigint").alias("left"), F.lit(0).alias("place"))
    before = Window.partitionBy("key").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.unionByName(tails).withColumn("carried", F.last("left", ignorenulls=True).over(before)).filter("place = 0 AND carried IS NOT NULL")
    looked = rows.withColumn("prev", F.last(F.when(end, F.col("id")), ignorenulls=True).over(within))
    # A row a part.
    both = looked.join(F.broadcast(carried.select("part", "key", "carried")), ["part", "key"], "left")
    return both.withColumn("prev", F.coalesce("prev", "carried")).drop("carried")


def _alive(steps: DataFrame, moved: DataFrame) -> DataFrame:
    """id of each step after which its key has a row.

    After a move there is one if there was one at its source (src) or at its target (prev) before. Each
    round settles the moves whose answers are known, and lets all others with a single open question
    point past it; so chains of moves take a number of rounds that grows with the logarithm of their length.
    """
    known = steps.filter("kind NOT IN ('in', 'set')").select("id", F.col("kind").isin("base", "insert").alias("val"))
    waiting, rounds = moved.select("id", F.col("src").alias("p"), F.col("prev").alias("q")), 0
    while True:
        a, b = known.select(F.col("id").alias("p"), F.col("val").alias("pv")), known.select(F.col("id").alias("q"), F.col("val").alias("qv"))
        asked = waiting.join(a, "p", "left").join(b, "q", "left")
        pv, qv = F.when(F.col("p").isNull(), False).otherwise(F.col("pv")), F.when(F.col("q").isNull(), False).otherwise(F.col("qv"))
        asked = asked.select(
            "id",
            F.when(~pv, None).otherwise(F.col("p")).alias("p"),
            F.when(~qv | F.col("p").eqNullSafe(F.col("q")), None).otherwise(F.col("q")).alias("q"),
            F.when(F.coalesce(pv, F.lit(False)) | F.coalesce(qv, F.lit(False)), True).when(~F.coalesce(pv, F.lit(True)) & ~F.coalesce(qv, F.lit(True)), False).alias("val"),
        )
        asked = stored(asked)
        known = known.unionByName(asked.filter("val IS NOT NULL").select("id", "val"))
        waiting = asked.filter("val IS NULL").select("id", "p", "q")
        if waiting.isEmpty():
            return known.filter("val").select("id")
        rounds += 1
        if rounds % 8 == 0:
            known = stored(known)
        single = waiting.filter("p IS NULL OR q IS NULL").select(F.col("id").alias("s"), F.coalesce("p", "q").alias("past"))
        for side in ("p", "q"):
            waiting = waiting.join(single, F.col(side) == F.col("s"), "left").withColumn(side, F.coalesce("past", side)).drop("s", "past")


def _origins(links: DataFrame) -> DataFrame:
    """id and root of each (id, parent), where a root is its own parent, by pointer doubling over those that are none."""
    roots = links.filter("id = parent").select("id", F.col("parent").alias("root"))
    now = stored(links.filter("id <> parent").select("id", F.col("parent").alias("root")))
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        after = stored(now.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        now = after.select("id", "root")
        if after.filter("moved").isEmpty():
            return stored(roots.unionByName(now))


def _fold_moved(rows: DataFrame, events: DataFrame, schema: T.StructType, keys: list[str], on_conflict: str, total: int, max_length: int = 0) -> DataFrame:
    """``_fold`` where updates move rows: keys that moves touch are resolved together, all others apart from them."""
    moves = events.filter(MOVES)
    linked = stored(moves.select(F.explode(F.array("row_key", "to_key")).alias("node")).distinct())
    # Stored with what they meet, as each is read several times below.
    rows = stored(rows.join(linked, F.col("_bk") == F.col("node"), "left").select("b", "_bk", F.col("node").isNotNull().alias("linked")))
    events = stored(events.join(linked, F.col("row_key") == F.col("node"), "left").select(*events.columns, F.col("node").isNotNull().alias("linked")))
    here = rows.filter("linked").select("b", "_bk", F.struct(*[F.col("b")[k].alias(k) for k in keys]).alias("own"))
    steps = _timeline(here, events.filter("linked"))
    out = steps.filter("kind = 'out'").select(F.col("at").alias("_at"), F.col("prev").alias("src"))
    moved = stored(steps.filter("kind = 'in'").join(out, F.col("at") == F.col("_at")).drop("_at"))
    alive = stored(_alive(steps, moved))
    src, before = alive.withColumnRenamed("id", "src").withColumn("from_src", F.lit(True)), alive.withColumnRenamed("id", "prev").withColumn("from_prev", F.lit(True))
    # The step whose row a step goes on with: its own where the row begins.
    arrived = moved.join(src, "src", "left").join(before, "prev", "left")
    arrived = arrived.withColumn("parent", F.when(F.col("from_src"), F.col("src")).when(F.col("from_prev"), F.col("prev"))).filter("parent IS NOT NULL")
    arrived = stored(arrived)
    inserted = steps.filter("kind = 'insert'").join(before, "prev", "left")
    onto = F.lit(False) if on_conflict == "replace" else F.coalesce("from_prev", F.lit(False))
    inserted = inserted.withColumn("parent", F.when(onto, F.col("prev")).otherwise(F.col("id")))
    links = steps.filter("kind = 'base'").select("id", F.col("id").alias("parent")).unionByName(arrived.select("id", "parent")).unionByName(inserted.select("id", "parent"))
    roots = _origins(links)
    last = steps.filter("kind <> 'set'").groupBy("key").agg(F.max_by(F.struct("id", "own"), "at").alias("last"))
    ends = last.select(F.col("last.id").alias("id"), F.col("last.own").alias("now")).join(roots, "id").select(F.col("root").cast("string").alias("_root"), "now")

    def under_root(part: DataFrame, by: str, kind: str) -> DataFrame:
        found = part.join(roots.withColumnRenamed("id", "_of"), F.col(by) == F.col("_of"))
        return found.select(F.col("root").cast("string").alias("row_key"), "own", "at", F.lit(kind).alias("kind"), "new", "set_cols")

    told = under_root(steps.filter("kind = 'set'"), "prev", "update").unionByName(under_root(arrived.filter("from_src"), "id", "update"))
    told = told.unionByName(under_root(inserted.filter("parent = id"), "id", "insert"))
    if on_conflict == "upsert":
        told = told.unionByName(under_root(inserted.filter("parent <> id"), "id", "update"))
    begun = steps.filter("kind = 'base'").select("key", F.col("id").cast("string").alias("_root"))
    begun = here.join(begun, F.col("_bk") == F.col("key")).select("b", F.col("_root").alias("_bk"))
    followed = _fold(begun, told, schema, keys, "replace", total, max_length).join(ends, F.col("_id") == F.col("_root"))
    followed = followed.select(*[F.col("now")[f.name].alias(f.name) if f.name in keys else F.col(f.name) for f in schema.fields])
    plain = _fold(rows.filter("NOT linked").drop("linked"), events.filter("NOT linked").drop("linked"), schema, keys, on_conflict, total, max_length)
    return plain.drop("_id").unionByName(followed)


def split_key_changes(changes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(plain, moves): updates that set a key column to another value, apart from all other events."""
    moved = reduce(lambda a, b: a | b, [F.array_contains("set_cols", k) & ~F.col("new")[k].eqNullSafe(F.col("key")[k]) for k in keys])
    moved = F.coalesce((F.col("kind") == "update") & moved, F.lit(False))
    return changes.filter(~moved), changes.filter(moved)


def change_stats(events: DataFrame, rejects: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row: received, applied, failed, skipped."""
    skipped = F.lower("table").isin(*INTERNAL, *[t.lower() for t in skip])
    no_key = F.col("kind").isin("update", "delete") & (F.coalesce(F.size("key"), F.lit(0)) < 1)
    nothing = (F.col("kind") == "update") & (F.coalesce(F.size("set_cols"), F.lit(0)) < 1)
    bad = (no_key | nothing) & ~skipped
    return events.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(~skipped & ~bad).alias("applied"), F.count_if(bad).alias("failed"), F.count_if(skipped).alias("skipped")
    )


def classify_ddl(log: DataFrame) -> DataFrame:
    """A DDL log (id, object_type, ddl, target_ddl) with ``action``: apply, skip or manual.

    An empty or commented target statement is left to a person. Sequence rows are never applied; a TABLE
    statement only on the table's own row, an INDEX statement only on the index's row; others are out of
    scope.
    """
    text, kind, target = F.upper(F.trim("ddl")), F.upper("object_type"), F.trim(F.coalesce("target_ddl", F.lit("")))
    table = text.rlike("\\A(CREATE|ALTER|DROP) TABLE")
    index = text.rlike("\\A(CREATE UNIQUE INDEX|CREATE INDEX|DROP INDEX)")
    apply = (kind != "SEQUENCE") & ((table & (kind == "TABLE")) | (index & (kind == "INDEX")))
    return log.withColumn("action", F.when((target == "") | target.startswith("--"), "manual").when(apply, "apply").otherwise("skip"))


def bootstrap(base: DataFrame, changes: DataFrame, keys: list[str], lsn0: int, on_conflict: str = "replace", max_length: int = 0) -> DataFrame:
    """A snapshot taken at position lsn0, and the changes after it. Replaying more than once gives the same."""
    return apply_changes(base, changes.filter(F.col("lsn") > lsn0), keys, on_conflict, max_length)


def glob_to_regex(pattern: str, compat: bool = False) -> str:
    """A Java pattern for a name with ``*``; compat leaves the end open, so that ``*_log`` also takes ``a_log_x``."""
    quoted = ".*".join("\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E" if part else "" for part in pattern.split("*"))
    return "(?s)\\A" + quoted + ("" if compat and "*" in pattern else "\\z")


def table_filter(df: DataFrame, include: tuple = (), exclude: tuple = (), include_schemas: tuple = (), exclude_schemas: tuple = (), compat: bool = False) -> DataFrame:
    """Rows of (schema, table) by globs: excluded schemas and tables go first, then included tables decide, then included schemas, then all pass.

    Table patterns are held against ``schema.table``.
    """
    def any_of(patterns: tuple, tables: bool) -> Column:
        out = F.lit(False)
        for p in patterns:
            subject = F.concat_ws(".", "schema", "table") if tables else F.col("schema")
            out = out | subject.rlike(glob_to_regex(p, compat))
        return out

    allowed = any_of(include, True) if include else any_of(include_schemas, False) if include_schemas else F.lit(True)
    return df.filter(~any_of(exclude_schemas, False) & ~any_of(exclude, True) & allowed)

