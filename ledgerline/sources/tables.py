"""Tables in and out: scans, inventories, text files, write policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.canonical import bytea_to_binary, export_text, tsv_unescape
from ledgerline.operators.compare import key_collisions


def read_table(spark: SparkSession, location: str, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table in a folder, or behind any Spark source (``fmt='jdbc'``: location is the URL)."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
    return spark.read.format(fmt).options(**options).load(f"{location}/{name}.{fmt}")


def project_arrays_as_json(df: DataFrame) -> DataFrame:
    """All columns, arrays as JSON text; null arrays stay null."""
    return df.select(*[F.when(F.col(f.name).isNotNull(), F.to_json(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def list_tables(inventory: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows of an inventory (schema, table) by exact table names, without regard to case."""
    name = F.lower("table")
    keep: Column = F.lit(True)
    if include:
        keep = keep & name.isin([t.lower() for t in include])
    if exclude:
        keep = keep & ~name.isin([t.lower() for t in exclude])
    return inventory.filter(keep)


def estimate_rows(df: DataFrame) -> DataFrame:
    """One row, n_rows. No column is read: Parquet answers the count from its footers."""
    return df.select().groupBy().agg(F.count(F.lit(1)).alias("n_rows"))


def estimate_rows_by_statistics(df: DataFrame) -> DataFrame:
    """One row, n_rows, by the optimizer's statistics: the row count of an analysed table, else the size over the width of a row."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    width = 8 + sum(_width(f.dataType) for f in df.schema.fields)
    n = int(str(rows.get())) if rows.isDefined() else int(str(stats.sizeInBytes())) // width
    return df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n_rows"))


def _width(kind: T.DataType) -> int:
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    return fixed.get(kind.simpleString(), 20 if isinstance(kind, T.StringType) else 8)


def tsv_lines(df: DataFrame) -> DataFrame:
    """One text column, value: tab-separated lines with escapes, NULL as ``\\N``, no header, no quotes."""
    return df.select(F.concat_ws("\t", *[export_text(F.col(f.name), f.dataType) for f in df.schema.fields]).alias("value"))


def write_tsv(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """``tsv_lines`` as text files; ``by`` names a column that splits them into folders and is left out of the lines."""
    if by is None:
        tsv_lines(df).write.mode(mode).text(path)
        return
    rest = df.drop(by)
    line = F.concat_ws("\t", *[export_text(F.col(f.name), f.dataType) for f in rest.schema.fields]).alias("value")
    df.select(line, by).write.mode(mode).partitionBy(by).text(path)


def parse_tsv(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns from lines of ``tsv_lines``; a value that does not fit its type becomes null (see ``tsv_misfits``)."""
    return lines.select(*[value.alias(name) for name, _, value in _tsv_cells(schema)])


def tsv_misfits(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines of which a value does not fit its type, or with another number of fields, with an array bad_columns."""
    bad = [F.when(text.isNotNull() & value.isNull(), F.lit(name)) for name, text, value in _tsv_cells(schema)]
    count = F.when(F.size(F.split("value", "\t", -1)) != len(schema.fields), F.lit("number of fields"))
    return lines.withColumn("bad_columns", F.array_compact(F.array(count, *bad))).filter(F.size("bad_columns") > 0)


def _tsv_cells(schema: T.StructType) -> list[tuple[str, Column, Column]]:
    """Name, text and typed value of each field of a line."""
    parts = F.split("value", "\t", -1)
    columns = []
    for k, f in enumerate(schema.fields):
        text = tsv_unescape(F.get(parts, F.lit(k)))
        if isinstance(f.dataType, T.BooleanType):
            value = F.when(text == "1", True).when(text == "0", False).otherwise(text.try_cast("boolean"))
        elif isinstance(f.dataType, T.BinaryType):
            value = bytea_to_binary(text)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json(text, f.dataType)
        else:
            value = text.try_cast(f.dataType)
        columns.append((f.name, text, value))
    return columns


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_tsv(spark.read.option("lineSep", "\n").text(path), schema)


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """db, table, n_records from shards named ``{db}.{table}.*.csv``; a last line without an end counts."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "^([^.]+)\\.([^.]+)\\.(?:.*\\.)?csv$", 0)
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("file"), name.alias("name")).filter("name <> ''")
    return rows.groupBy(F.split("file", "\\.")[0].alias("db"), F.split("file", "\\.")[1].alias("table")).agg(F.count(F.lit(1)).alias("n_records"))


def write_table(df: DataFrame, path: str, policy: str = "insert", keys: list[str] | None = None) -> None:
    """insert appends, after a check that no key is there already; truncate and drop replace the rows.

    truncate keeps the schema the target has, and fails if it cannot take the rows; drop takes the new one.
    """
    spark = df.sparkSession
    if policy == "insert":
        there = _existing(spark, path)
        if there is not None and keys and not key_collisions(df, there, keys).isEmpty():
            raise ValueError(f"keys of the rows to insert are already in {path}")
        df.write.mode("append").parquet(path)
    elif policy == "truncate":
        there = _existing(spark, path)
        if there is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in there.schema.fields])
        df.write.mode("overwrite").parquet(path)
    elif policy == "drop":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown policy {policy!r}")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, mode: str = "append", **options: str) -> None:
    """Batched inserts in one transaction a partition; Spark retries a partition that fails."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), isolationLevel="READ_COMMITTED", **options).mode(mode).save()


def catalog_of(spark: SparkSession, by_name: dict[str, DataFrame], schema: str = "public", keys: dict[str, list[str]] | None = None) -> DataFrame:
    """A columns table (schema, table, column, position, data_type, nullable, is_primary) from tables' schemas."""
    rows = [
        (schema, table, f.name, k + 1, f.dataType.simpleString(), f.nullable, f.name in (keys or {}).get(table, []))
        for table, df in by_name.items()
        for k, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "schema string, table string, column string, position int, data_type string, nullable boolean, is_primary boolean")


def read_ddl_log(df: DataFrame, since_id: int) -> DataFrame:
    """Entries of a DDL log after a cursor, in order."""
    return df.filter(F.col("id") > since_id).orderBy("id")


def recent_ddl(log: DataFrame, n: int = 1000) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)
