"""Schema profiling over catalog tables: type mapping, keys, and compatibility findings with a score.

Catalogs of a whole fleet are ordinary tables, one row for each object, so every rule is a projection or a
join with a small rule table. Inputs, by name: tables (schema, table), columns (schema, table, column,
data_type, column_default, is_primary, precision, scale, max_length), indexes (schema, table, index,
index_type, is_partial, is_expression), views (schema, view, definition), and functions, triggers, enums,
extensions, sequences with a column name (and schema).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of the dimensions, scores of the levels.
WEIGHTS = {"data_type": 0.25, "structure": 0.20, "index": 0.15, "view": 0.10, "function": 0.10, "trigger": 0.05, "custom_type": 0.05, "extension": 0.05, "sequence": 0.05}
SCORES = {"compatible": 100.0, "convertible": 75.0, "manual_needed": 40.0, "incompatible": 0.0}
#: Level of each data type; arrays and everything unknown are manual_needed.
TYPE_LEVELS = {
    "integer": "compatible", "int": "compatible", "int4": "compatible", "bigint": "compatible", "int8": "compatible", "smallint": "compatible", "int2": "compatible",
    "text": "compatible", "character varying": "compatible", "varchar": "compatible", "numeric": "compatible", "decimal": "compatible",
    "real": "compatible", "float4": "compatible", "double precision": "compatible", "float8": "compatible", "boolean": "compatible", "bool": "compatible",
    "date": "compatible", "timestamp without time zone": "compatible", "timestamp": "compatible", "bytea": "compatible", "json": "compatible",
    "character": "convertible", "bpchar": "convertible", "timestamp with time zone": "convertible", "timestamptz": "convertible", "jsonb": "convertible", "uuid": "convertible", "money": "convertible",
    "bit": "manual_needed", "bit varying": "manual_needed", "varbit": "manual_needed", "xml": "manual_needed", "cidr": "manual_needed", "inet": "manual_needed", "macaddr": "manual_needed",
    "interval": "incompatible", "point": "incompatible", "line": "incompatible", "lseg": "incompatible", "box": "incompatible", "path": "incompatible", "polygon": "incompatible", "circle": "incompatible",
}
#: Index types that need no change, syntax that only the source has, levels of known extensions.
PLAIN_INDEX = "btree"
VIEW_TOKENS = [
    "ARRAY_AGG", "STRING_AGG", "BOOL_AND", "BOOL_OR", "EXTRACT(EPOCH", "TO_CHAR", "TO_NUMBER", "TO_DATE", "REGEXP_REPLACE", "REGEXP_MATCHES",
    "GENERATE_SERIES", "ROW_NUMBER()", "LATERAL", "WITH RECURSIVE", "ILIKE", "SIMILAR TO", "::", "CAST(", "NOW()", "CURRENT_DATE",
]
EXTENSION_LEVELS = {
    "plpgsql": "incompatible", "uuid-ossp": "manual_needed", "pgcrypto": "manual_needed", "pg_stat_statements": "incompatible", "postgis": "incompatible",
    "hstore": "manual_needed", "ltree": "incompatible", "pg_trgm": "incompatible", "btree_gin": "incompatible", "btree_gist": "incompatible",
}
#: Source type, target type, support level.
TYPE_MAP = [
    ("smallint", "SMALLINT", "supported"), ("integer", "INT", "supported"), ("bigint", "BIGINT", "supported"),
    ("serial", "INT AUTO_INCREMENT", "convert"), ("bigserial", "BIGINT AUTO_INCREMENT", "convert"), ("smallserial", "SMALLINT AUTO_INCREMENT", "convert"),
    ("real", "FLOAT", "supported"), ("double precision", "DOUBLE", "supported"), ("numeric", "DECIMAL", "supported"), ("decimal", "DECIMAL", "supported"),
    ("money", "DECIMAL(19,2)", "convert"), ("character", "CHAR", "supported"), ("character varying", "VARCHAR", "supported"), ("text", "TEXT", "supported"),
    ("bytea", "BLOB", "convert"), ("boolean", "TINYINT(1)", "convert"), ("date", "DATE", "supported"),
    ("time without time zone", "TIME", "supported"), ("time with time zone", "TIME", "convert"),
    ("timestamp without time zone", "DATETIME(6)", "supported"), ("timestamp with time zone", "TIMESTAMP(6)", "convert"), ("interval", "VARCHAR(64)", "convert"),
    ("json", "JSON", "supported"), ("jsonb", "JSON", "convert"), ("uuid", "CHAR(36)", "convert"), ("macaddr", "VARCHAR(17)", "convert"), ("macaddr8", "VARCHAR(23)", "convert"),
    ("inet", "VARCHAR(43)", "convert"), ("cidr", "VARCHAR(43)", "convert"), ("bit", "BIT", "supported"), ("bit varying", "BIT", "convert"), ("xml", "LONGTEXT", "convert"),
    ("array", "JSON", "convert"), ("enum", "ENUM", "convert"),
    *[(t, None, "unsupported") for t in ("tsvector", "tsquery", "point", "line", "lseg", "box", "path", "polygon", "circle", "user-defined")],
]
#: Other names of the same types.
ALIASES = {
    "int2": "smallint", "int": "integer", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "bool": "boolean", "bpchar": "character", "char": "character",
    "varchar": "character varying", "time": "time without time zone", "timetz": "time with time zone", "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone", "varbit": "bit varying",
}

FINDING = ["dimension", "object_type", "object_name", "level", "detail"]


def _rules(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table: its size is fixed by this module."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _findings(df: DataFrame, dimension: str, object_type: str, name: Column, level: Column | str, detail: Column) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    return df.select(F.lit(dimension).alias("dimension"), F.lit(object_type).alias("object_type"), name.alias("object_name"), level.alias("level"), detail.alias("detail"))


def _type_name(c: str = "data_type") -> Column:
    name = F.lower(F.trim(c))
    found = reduce(lambda out, kv: out.when(name == kv[0], kv[1]), list(ALIASES.items())[1:], F.when(name == list(ALIASES)[0], ALIASES[list(ALIASES)[0]]))
    return found.when(name.endswith("[]") | name.startswith("_"), "array").otherwise(name)


def map_type(columns: DataFrame) -> DataFrame:
    """``columns`` with target_type and support, by the type map and the column's precision, scale and length.

    Unknown and unsupported types become TEXT.
    """
    rules = _rules(columns.sparkSession, TYPE_MAP, "_type string, _target string, support string")
    rows = columns.withColumn("_name", _type_name()).join(rules, F.col("_name") == F.col("_type"), "left")
    p, s, n = F.coalesce("precision", F.lit(0)), F.coalesce("scale", F.lit(0)), F.coalesce("max_length", F.lit(0))
    name = F.col("_name")
    target = (
        F.when(F.col("_target").isNull(), "TEXT")
        .when(name.isin("numeric", "decimal"), F.when((p > 0) & (s > 0), F.format_string("DECIMAL(%d,%d)", p, s)).when(p > 0, F.format_string("DECIMAL(%d)", p)).otherwise("DECIMAL"))
        .when(name == "character varying", F.when(n > 0, F.format_string("VARCHAR(%d)", n)).otherwise("TEXT"))
        .when(name == "character", F.when(n > 0, F.format_string("CHAR(%d)", n)).otherwise("CHAR(255)"))
        .when(name.isin("bit", "bit varying") & (n > 0), F.format_string("BIT(%d)", n))
        .otherwise(F.col("_target"))
    )
    return rows.select(*columns.columns, target.alias("target_type"), F.coalesce("support", F.lit("unsupported")).alias("support"))


def default_expr(columns: DataFrame) -> DataFrame:
    """``columns`` with target_default: literals, booleans as 1 and 0, CURRENT_TIMESTAMP; null for everything else.

    A cast (``::type``) is cut off a literal; sequences and NULL have no default.
    """
    text = F.trim(F.coalesce("column_default", F.lit("")))
    upper = F.upper(text)
    stamp = _type_name().isin("timestamp without time zone", "timestamp with time zone")
    raw = F.when(text.rlike("(?s)\\A.+?::"), F.trim(F.substring_index(text, "::", 1))).otherwise(text)
    literal = (raw.startswith("'") & raw.endswith("'") & (F.length(raw) > 1)) | raw.rlike("\\A[0-9.+-]+\\z")
    value = (
        F.when((text == "") | (upper == "NULL") | upper.contains("NEXTVAL"), F.lit(None).cast("string"))
        .when(upper.contains("CURRENT_TIMESTAMP"), F.when(stamp, "CURRENT_TIMESTAMP(6)").otherwise("CURRENT_TIMESTAMP"))
        .when(upper == "TRUE", "1")
        .when(upper == "FALSE", "0")
        .when(literal & (F.upper(raw) != "NULL"), raw)
    )
    return columns.withColumn("target_default", value)


def primary_keys(columns: DataFrame) -> DataFrame:
    """schema, table, key_columns (in order) of the tables that have a key."""
    keyed = columns.filter("is_primary")
    return keyed.groupBy("schema", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("key_columns"))


def index_columns(index_parts: DataFrame) -> DataFrame:
    """schema, table, index, index_columns from (schema, table, index, position, column)."""
    return index_parts.groupBy("schema", "table", "index").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("index_columns"))


def enum_labels(labels: DataFrame) -> DataFrame:
    """schema, enum, labels (in order) from (schema, enum, position, label)."""
    return labels.groupBy("schema", "enum").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("labels"))


def foreign_keys(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """schema, table, constraint, columns, ref_table, ref_columns, delete_rule from key columns and their rules.

    parts: schema, table, constraint, position, column, ref_table, ref_column; rules: schema, constraint, delete_rule.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "column", "ref_column")))
    grouped = parts.groupBy("schema", "table", "constraint", "ref_table").agg(ordered.alias("p"))
    return grouped.join(rules, ["schema", "constraint"], "left").select(
        "schema", "table", "constraint", F.transform("p", lambda x: x["column"]).alias("columns"), "ref_table", F.transform("p", lambda x: x["ref_column"]).alias("ref_columns"), "delete_rule"
    )


def tables_without_pk(tables: DataFrame, columns: DataFrame) -> DataFrame:
    return tables.select("schema", "table").join(columns.filter("is_primary").select("schema", "table").distinct(), ["schema", "table"], "left_anti")


def _object(*parts: str) -> Column:
    return F.concat_ws(".", *parts)


def assess_data_type(columns: DataFrame) -> DataFrame:
    rules = _rules(columns.sparkSession, list(TYPE_LEVELS.items()), "_type string, _level string")
    rows = columns.withColumn("_name", F.lower("data_type")).join(rules, F.col("_name") == F.col("_type"), "left")
    return _findings(rows, "data_type", "column", _object("schema", "table", "column"), F.coalesce("_level", F.lit("manual_needed")), F.col("_name"))


def assess_structure(tables: DataFrame, columns: DataFrame) -> DataFrame:
    none = _findings(tables_without_pk(tables, columns), "structure", "table", _object("schema", "table"), "manual_needed", F.lit("no primary key"))
    text = F.lower(F.coalesce("column_default", F.lit("")))
    now = text.contains("now()") | text.contains("current_timestamp")
    unique = text.contains("uuid_generate_v4()") | text.contains("gen_random_uuid()")
    level = F.when(text.contains("nextval("), F.lit(None).cast("string")).when(now, "convertible").when(unique, "manual_needed")
    defaults = _findings(columns.withColumn("_level", level).filter("_level IS NOT NULL"), "structure", "column_default", _object("schema", "table", "column"), F.col("_level"), text)
    return none.unionByName(defaults)


def assess_index(indexes: DataFrame) -> DataFrame:
    """A finding for each index, and one more each for being partial and for being on an expression."""
    kind = F.lower("index_type")
    parts = F.array_compact(
        F.array(
            F.struct(F.when(kind == PLAIN_INDEX, "compatible").otherwise("convertible").alias("level"), kind.alias("detail")),
            F.when(F.col("is_partial"), F.struct(F.lit("convertible").alias("level"), F.lit("partial index").alias("detail"))),
            F.when(F.col("is_expression"), F.struct(F.lit("convertible").alias("level"), F.lit("expression index").alias("detail"))),
        )
    )
    rows = indexes.select("table", "index", F.explode(parts).alias("f"))
    return _findings(rows, "index", "index", _object("table", "index"), F.col("f.level"), F.col("f.detail"))


def assess_view(views: DataFrame) -> DataFrame:
    text = F.upper("definition")
    found = reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in VIEW_TOKENS])
    level = F.when(F.col("_n") == 0, "compatible").when(F.col("_n") <= 2, "convertible").otherwise("manual_needed")
    return _findings(views.withColumn("_n", found), "view", "view", _object("schema", "view"), level, F.concat(F.col("_n").cast("string"), F.lit(" tokens")))


def assess_objects(objects: DataFrame, dimension: str, object_type: str) -> DataFrame:
    """Functions, triggers, custom types and sequences: each object is convertible."""
    return _findings(objects, dimension, object_type, F.col("name"), "convertible", F.lit(object_type))


def assess_extension(extensions: DataFrame) -> DataFrame:
    rules = _rules(extensions.sparkSession, list(EXTENSION_LEVELS.items()), "_ext string, _level string")
    rows = extensions.join(rules, F.col("name") == F.col("_ext"), "left")
    return _findings(rows, "extension", "extension", F.col("name"), F.coalesce("_level", F.lit("manual_needed")), F.col("name"))


def assess(catalog: dict[str, DataFrame]) -> DataFrame:
    """Findings of all dimensions for the catalog tables that are given."""
    parts = []
    if "columns" in catalog:
        parts.append(assess_data_type(catalog["columns"]))
        if "tables" in catalog:
            parts.append(assess_structure(catalog["tables"], catalog["columns"]))
    if "indexes" in catalog:
        parts.append(assess_index(catalog["indexes"]))
    if "views" in catalog:
        parts.append(assess_view(catalog["views"]))
    for name, dimension, kind in (("functions", "function", "function"), ("triggers", "trigger", "trigger"), ("enums", "custom_type", "enum"), ("sequences", "sequence", "sequence")):
        if name in catalog:
            parts.append(assess_objects(catalog[name], dimension, kind))
    if "extensions" in catalog:
        parts.append(assess_extension(catalog["extensions"]))
    return reduce(DataFrame.unionByName, parts)


def level_score(level: str = "level") -> Column:
    out = F.lit(None).cast("double")
    for name, score in SCORES.items():
        out = F.when(F.col(level) == name, F.lit(score)).otherwise(out)
    return out


def dimension_scores(findings: DataFrame) -> DataFrame:
    """dimension, findings, score for every dimension: the mean of its levels' scores, 100 without findings."""
    every = _rules(findings.sparkSession, list(WEIGHTS.items()), "dimension string, weight double")
    means = findings.groupBy("dimension").agg(F.count(F.lit(1)).alias("findings"), F.avg(level_score()).alias("score"))
    return means.join(every, "dimension", "right").select("dimension", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("score", F.lit(100.0)).alias("score"), "weight")


def overall_score(scores: DataFrame) -> DataFrame:
    """One row, score and level: the weighted sum; compatible from 90, convertible from 70, manual_needed from 40."""
    total = scores.agg(F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score"))
    return total.withColumn("level", F.when(F.col("score") >= 90, "compatible").when(F.col("score") >= 70, "convertible").when(F.col("score") >= 40, "manual_needed").otherwise("incompatible"))


def level_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count(F.lit(1)).alias("findings"))


def problem_list(findings: DataFrame, n: int = 50) -> DataFrame:
    """The first n findings that are not compatible: incompatible, then manual_needed, then convertible."""
    rank = F.when(F.col("level") == "incompatible", 0).when(F.col("level") == "manual_needed", 1).otherwise(2)
    return findings.filter("level <> 'compatible'").withColumn("rank", rank).orderBy("rank", "dimension", "object_name", "detail").limit(n).drop("rank")


def unsupported(triggers: DataFrame, functions: DataFrame) -> DataFrame:
    """object_type, name of what is not moved."""
    return triggers.select(F.lit("trigger").alias("object_type"), "name").unionByName(functions.select(F.lit("function").alias("object_type"), "name"))


def precheck(catalog: dict[str, DataFrame], collation: str = "UTF8") -> DataFrame:
    """item, n, status: counts of objects that are not moved (warn above 0), and the collation (warn unless UTF)."""
    parts = []
    for name in ("triggers", "functions", "enums", "extensions"):
        if name in catalog:
            n = F.count_distinct("name") if name == "enums" else F.count(F.lit(1))
            parts.append(catalog[name].agg(n.alias("n")).select(F.lit(name).alias("item"), "n", F.when(F.col("n") > 0, "warn").otherwise("pass").alias("status")))
    spark = next(iter(catalog.values())).sparkSession
    parts.append(spark.range(1).select(F.lit("collation").alias("item"), F.lit(1).cast("bigint").alias("n"), F.lit("pass" if "utf" in collation.lower() else "warn").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def schema_plan(source: DataFrame, target: DataFrame, policy: str = "insert") -> DataFrame:
    """table, action for each source table: create where it is absent; else skip under insert, recreate under drop, keep under truncate."""
    there = target.select(F.lower("table").alias("_t")).distinct().withColumn("_there", F.lit(True))
    action = {"insert": "skip", "drop": "recreate", "truncate": "keep"}[policy]
    return source.join(there, F.lower("table") == F.col("_t"), "left").select("table", F.when(F.col("_there"), action).otherwise("create").alias("action"))


def _type_conform(spark_type: str, c: Column) -> Column:
    if spark_type in ("boolean", "bool"):
        return F.when(c.cast("string").isin("true", "t", "1"), F.lit(1)).when(c.cast("string").isin("false", "f", "0"), F.lit(0)).cast("tinyint")
    if spark_type == "money":
        return F.regexp_replace(c.cast("string"), "[^0-9.-]", "").try_cast("decimal(19,2)")
    if spark_type == "uuid":
        return F.lower(c.cast("string"))
    if spark_type == "time with time zone":
        return F.regexp_replace(c.cast("string"), "([+-]\\d{2}(:?\\d{2})?|Z)\\z", "")
    if spark_type == "interval":
        return c.cast("string")
    if spark_type.startswith(("decimal", "numeric")):
        return c.try_cast(spark_type.replace("numeric", "decimal") if "(" in spark_type else "decimal(38,18)")
    return c.try_cast(spark_type)


def conform(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): columns named in ``types`` in their target type; other columns as they are.

    Types are Spark's, and boolean (to 1 and 0), money, uuid, interval, time with time zone. A row of
    which a value does not fit its type goes to rejects unchanged, with an array bad_columns.
    """
    name = {c.lower(): c for c in df.columns}
    new = {name[c.lower()]: _type_conform(t.lower(), F.col(name[c.lower()])) for c, t in types.items() if c.lower() in name}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in new.items()])) if new else F.array().cast("array<string>")
    judged = df.withColumn("bad_columns", bad)
    rows = judged.filter(F.size("bad_columns") == 0).select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    return rows, judged.filter(F.size("bad_columns") > 0)
