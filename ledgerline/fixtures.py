"""Targets, feeds and catalogs derived from the given tables, for queries and tests.

Each is a plain projection of whole tables, so that its work grows with them and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
DATA_TYPES = ["integer", "text", "character", "jsonb", "interval", "xml", "numeric", "uuid", "text[]", "character varying", "timestamp with time zone", "hstore", "boolean", "point", "bit", "bigint"]
DEFAULTS = ["", "nextval('s')", "now()", "gen_random_uuid()", "'x'::text", "true", "42", "NULL::text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drifted_lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem and a copy without some orders, with changed flags and with repeated rows."""
    source = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_orderkey") % 997 == 3, "X").otherwise(F.col("l_returnflag"))
    target = source.filter("l_orderkey % 1000 <> 7").withColumn("l_returnflag", flag)
    return source, target.unionByName(source.filter("l_orderkey % 1009 = 11"))


def drifted_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders and a copy with deleted, changed and added keys."""
    source = table(spark, sf_dir, "orders")
    changed = source.filter("o_orderkey % 10 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 2, "Z").otherwise(F.col("o_orderstatus")))
    added = source.filter("o_orderkey % 10 = 3").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)
    return source, changed.unionByName(added)


def nearly_equal_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders and a copy with one more row in front, and a changed status at a few keys."""
    source = table(spark, sf_dir, "orders")
    least = source.agg(F.min("o_orderkey").alias("least"))
    front = source.join(F.broadcast(least), F.col("o_orderkey") == F.col("least"), "left_semi").withColumn("o_orderkey", F.col("o_orderkey") - 1_000_000)
    changed = source.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4999 == 17, "Z").otherwise(F.col("o_orderstatus")))
    return source, changed.unionByName(front)


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with CRLF, trailing blanks, NULL marks, tabs and backslashes in their texts."""
    text = F.col("text")
    k = F.col("doc_id") % 6
    noisy = (
        F.when(k == 0, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(k == 1, F.concat(text, F.lit(" \t\n")))
        .when(k == 2, F.lit("\\N"))
        .when(k == 3, F.concat(F.lit("a\tb\\"), text))
        .when(k == 4, F.lit(None).cast("string"))
        .otherwise(F.replace(text, F.lit("\n"), F.lit("\r")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", noisy.alias("text"))


def copied_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders whose key has a second part, o_copy, 0 for all of them: keys that a feed makes up have 1 there, and so meet no row however many orders there are."""
    return table(spark, sf_dir, "orders").withColumn("o_copy", F.lit(0))


def order_feed(spark: SparkSession, sf_dir: str, copied: bool = False) -> DataFrame:
    """Change events over orders, or with ``copied`` over ``copied_orders``, by the last digit of the key.

    1: update; 2: delete; 3: insert of a new key; 4: update, delete, update; 5: update of an absent key;
    6: insert over a row, then update; 7: delete, insert, update.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def text(c: str) -> F.Column:
        return F.col(c).cast("string")

    def event(digit: int, step: int, kind: str, cells: dict, shift: int = 0) -> DataFrame:
        copy = [F.lit("o_copy"), F.lit("1" if shift else "0")] if copied else []
        key = F.create_map(F.lit("o_orderkey"), (k + shift).cast("string"), *copy)
        pairs = [x for c, v in cells.items() for x in (F.lit(c), v)]
        new = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return o.filter(k % 10 == digit).select(
            (k * 10 + step).alias("lsn"), F.lit(0).alias("ordinal"), F.lit(None).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), F.lit("public").alias("schema"), F.lit("orders").alias("table"),
            key.alias("key"), new.cast("map<string,string>").alias("new"), F.array(*[F.lit(c) for c in cells]).cast("array<string>").alias("set_cols"), F.lit(None).cast("string").alias("ddl"),
        )

    status = lambda s: {"o_orderstatus": F.lit(s)}
    fresh = {"o_orderkey": (k + 1_000_000).cast("string"), "o_custkey": text("o_custkey"), "o_orderstatus": F.lit("I"), "o_totalprice": text("o_totalprice"), "o_orderdate": text("o_orderdate")}
    own = {"o_orderkey": k.cast("string")}
    parts = [
        event(1, 0, "update", status("U")),
        event(2, 0, "delete", {}),
        event(3, 0, "insert", fresh, 1_000_000),
        event(4, 0, "update", status("A")),
        event(4, 1, "delete", {}),
        event(4, 2, "update", status("B")),
        event(5, 0, "update", status("G"), 2_000_000),
        event(6, 0, "insert", own | status("N")),
        event(6, 1, "update", {"o_orderpriority": F.lit("9-NEW")}),
        event(7, 0, "delete", {}),
        event(7, 1, "insert", own | status("R")),
        event(7, 2, "update", {"o_totalprice": F.lit("1.5")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def faulty_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_feed`` with, by the key, updates without a key or a column, unknown and reserved tables."""
    from ledgerline.streaming.changes import INTERNAL

    feed = order_feed(spark, sf_dir)
    k = F.floor(F.col("lsn") / 10) % 40
    none = F.create_map().cast("map<string,string>")
    return (
        feed.withColumn("key", F.when(k == 1, none).otherwise(F.col("key")))
        .withColumn("set_cols", F.when(k == 11, F.array().cast("array<string>")).otherwise(F.col("set_cols")))
        .withColumn("table", F.when(k == 21, "unheard_of").when(k == 31, INTERNAL[0]).otherwise(F.col("table")))
    )


def typed_orders(spark: SparkSession, sf_dir: str, copied: bool = False) -> DataFrame:
    """orders with bytes, arrays and mixed-case names: OrderId, Payload, Tags, Grid, Open, Note, and with ``copied`` Copy, 0 (see ``copied_orders``)."""
    priority, status, customer = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("OrderId"), F.encode(priority, "UTF-8").alias("Payload"), F.array(status, priority).alias("Tags"),
        F.array(F.array(customer), F.array().cast("array<int>")).alias("Grid"), (F.col("o_orderkey") % 2 == 0).alias("Open"), priority.alias("Note"),
        *([F.lit(0).alias("Copy")] if copied else []),
    )


def typed_feed(spark: SparkSession, sf_dir: str, copied: bool = False) -> DataFrame:
    """Raw change messages for ``typed_orders``, whose names differ from the columns' by case, by the last digit of the key.

    1: bytes in hex; 2: a text that looks like them, for the same column; 3: a quoted array; 4: a nested one and a boolean; 5: a long text; 6: an insert
    of a new key; 7: a JSON array; 8: delete; 9: an array less deep than its column; 0: an unknown column, or another key column.
    """
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def cell(name: str, value: F.Column, kind: str = "text", is_key: bool = False) -> F.Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(kind).alias("type"), F.lit(is_key).alias("is_key"), F.lit(False).alias("unchanged"))

    def message(rows: F.Column, kind: str, cells: list, key: str = "orderid", shift: int = 0) -> DataFrame:
        own = [cell(key, (k + shift).cast("string"), "int8", True)]
        if copied:
            own.append(cell("COPY", F.lit("1" if shift else "0"), "int4", True))
        old = F.array(*own) if kind == "delete" else F.lit(None)
        new = F.array(*own, *cells) if kind != "delete" else F.lit(None)
        kinds = "array<struct<name:string,value:string,type:string,is_key:boolean,unchanged:boolean>>"
        return o.filter(rows).select(
            k.alias("lsn"), F.lit(0).alias("ordinal"), F.lit(None).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), F.lit("public").alias("schema"), F.lit("typed").alias("table"),
            new.cast(kinds).alias("columns"), old.cast(kinds).alias("old_columns"), F.lit(None).cast("string").alias("ddl"),
        )

    text, digit = F.lit, k % 10
    key = k.cast("string")
    parts = [
        message(digit == 1, "update", [cell("PAYLOAD", text("\\x0aff"), "bytea")]),
        message(digit == 2, "update", [cell("PAYLOAD", text("\\x41"), "text")], "ORDERID"),
        message(digit == 3, "update", [cell("tags", F.concat(text('{"x,y",NULL,"q\\"'), key, text('",NULLS}')))]),
        message(digit == 4, "update", [cell("GRID", F.concat(text("{{1,2},{NULL,"), key, text("}}")), "_int4"), cell("open", text("f"), "bool")]),
        message(digit == 5, "update", [cell("note", F.concat(text("long \U0001f600 "), key, text("n" * 40)))], "OrderId"),
        message(digit == 6, "insert", [cell("payload", text("\\x"), "oid_17"), cell("tags", text("{}")), cell("grid", text(None).cast("string")), cell("OPEN", text("1"))], shift=1_000_000),
        message(digit == 7, "update", [cell("Tags", text('["j",null]'), "jsonb")]),
        message(digit == 8, "delete", [], "ORDERID"),
        message(digit == 9, "update", [cell("grid", text("{1,2}"))]),
        message(k % 20 == 0, "update", [cell("colour", text("red"))]),
        message(k % 20 == 10, "update", [cell("note", text("lost"))], "other_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fleet(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Catalog tables of a fleet: a table for each supplier, a column for each part, and so on."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    suppliers = table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, DATA_TYPES)), (F.col("p_partkey") % len(DATA_TYPES) + 1).cast("int"))
    default = F.element_at(F.array(*map(F.lit, DEFAULTS)), (F.col("p_partkey") % len(DEFAULTS) + 1).cast("int"))
    name = lambda c, n: F.concat(F.lit("t"), (F.col(c) % n).cast("string"))
    columns = part.select(
        F.lit("public").alias("schema"), name("p_partkey", 97).alias("table"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column"), F.col("p_partkey").cast("int").alias("position"),
        kind.alias("data_type"), default.alias("column_default"), (F.col("p_partkey") % 3 == 0).alias("is_primary"), F.col("p_size").alias("precision"), (F.col("p_size") % 5).alias("scale"), (F.col("p_size") % 7).alias("max_length"),
    )
    index_type = F.element_at(F.array(*map(F.lit, ["btree", "hash", "GIN", "brin", "rum"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return {
        "tables": suppliers.select(F.lit("public").alias("schema"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("table")),
        "columns": columns,
        "indexes": customer.select(F.lit("public").alias("schema"), name("c_custkey", 97).alias("table"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("index"), index_type.alias("index_type"), (F.col("c_custkey") % 4 == 0).alias("is_partial"), (F.col("c_custkey") % 6 == 0).alias("is_expression")),
        "views": part.select(F.lit("public").alias("schema"), F.col("p_name").alias("view"), F.concat(F.lit("select "), F.when(F.col("p_partkey") % 2 == 0, "now(), ").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "x::text, cast(y as int), ").otherwise(""), F.col("p_brand")).alias("definition")),
        "functions": suppliers.select(F.col("s_name").alias("name")),
        "extensions": suppliers.select(F.element_at(F.array(*map(F.lit, ["plpgsql", "hstore", "postgis", "unheard_of"])), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("name")),
    }


def whole_fleet(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``fleet`` with triggers (a customer each), enums (a label for each nation, named by region) and sequences (a part each)."""
    nations = table(spark, sf_dir, "nation")
    return fleet(spark, sf_dir) | {
        "triggers": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")),
        "enums": nations.select(F.lit("public").alias("schema"), F.concat(F.lit("e"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("label")),
        "sequences": table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("name")),
    }


def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load ledger with an entry for each order."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ["completed", "running", "failed", "pending", "skipped", "odd"])), (k % 6 + 1).cast("int"))
    total = (k % 100 + 1).cast("bigint")
    done = F.when(state == "completed", total).when(state == "running", F.floor(total / 2)).otherwise(F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_name"), k.alias("chunk"), state.alias("state"), done.alias("rows_done"), total.alias("rows_total"), (k % 7).cast("double").alias("seconds"))


def table_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation report with a row for each customer: their orders against a drifted copy."""
    source, target = drifted_orders(spark, sf_dir)
    a = source.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("source_rows"))
    b = target.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("target_rows"))
    both = a.join(b, "o_custkey", "full_outer").fillna(0, ["source_rows", "target_rows"])
    diff = F.col("source_rows") - F.col("target_rows")
    status = F.when(diff == 0, "pass").when(F.abs(diff) == 1, "warn").otherwise("fail")
    return both.select(F.col("o_custkey").cast("string").alias("table_name"), status.alias("status"), "source_rows", "target_rows", diff.alias("diff_rows"))
