"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """Tables that ``stage`` writes while the scope is the innermost one."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        """Delete the tables. Call it once the results built on them are stored."""
        while self.paths:
            delete(spark, self.paths.pop())


_SCOPES: list[Scope] = []


@contextmanager
def scope() -> Iterator[Scope]:
    own = Scope()
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The table belongs to the innermost ``scope``, which may delete it; else it goes when the application ends.
    ``by`` gives each value of these columns a folder, and so files, of its own.
    """
    table, path = store(df, label, compression, by)
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return table


def store(df: DataFrame, label: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Like ``stage``, for tables of no scope; also gives the path, for ``delete``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _hadoop(spark, path)
    files.delete(folder, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Let a folder go when the application ends."""
    folder, files = _hadoop(spark, path)
    files.deleteOnExit(folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
