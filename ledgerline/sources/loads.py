"""Loads in chunks that can be killed at any point and go on, and reads over JDBC in ranges of any ordered key."""

from __future__ import annotations

import datetime
import decimal
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.compare import key_collisions
from ledgerline.operators.ranges import borders_until, key_borders
from ledgerline.plans.report import pending
from ledgerline.sources.folders import Folder

#: Chunks that one job writes: the borders between them travel as a constant of its plan.
WAVE = 64
LEDGER_SCHEMA = "table_name string, chunk bigint, state string, rows_done bigint, rows_total bigint, seconds double"
POLICIES = ("insert", "truncate", "drop")


class ChunkedLoad:
    """A load of ``source`` into the Parquet table at ``root`` by chunks of ``chunk_rows`` rows in key order.

    What a load is about to do is planned once and stored below ``root``: the borders between chunks and the table's schema. A wave of chunks is then written
    to a staging folder by one job, a task a chunk; a chunk's files are renamed into the table; and last comes the chunk's row in the ledger. A load that
    was killed goes on by its plan: chunks with a row are left alone, all others are done again, after files of theirs that have got into the table are
    removed. So each row is in the table once, wherever the load was stopped. The source must give the same rows again.

    insert adds to the table, after a check when the load is planned that none of its keys are there; truncate and drop empty the table once, when the load begins,
    not when it goes on; truncate keeps the table's schema, drop takes the source's. A load that has ended leaves no plan, and the next one begins anew.
    """

    def __init__(self, source: DataFrame, root: str, keys: list[str], chunk_rows: int = 500_000, policy: str = "insert") -> None:
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
        self.source, self.keys, self.chunk_rows, self.policy = source, list(keys), chunk_rows, policy
        self.spark: SparkSession = source.sparkSession
        self.folder = Folder(self.spark, root)
        self.table = self.folder.root.rpartition("/")[2]

    def _plan(self) -> dict:
        if "plan" not in self.folder.names("_load"):
            there = self._existing()
            if self.policy == "insert" and there is not None and not key_collisions(self.source, there, self.keys).isEmpty():
                raise ValueError(f"keys of the rows to insert are already in {self.folder.root}")
            keeps = self.policy != "drop" and there is not None
            if keeps and {c.lower() for c in there.columns} != {c.lower() for c in self.source.columns}:
                raise ValueError(f"the columns of {self.folder.root} are others than those of the rows")
            schema = there.schema if keeps else self.source.schema
            self.folder.delete("_load")
            borders = key_borders(self.source, self.keys, self.chunk_rows)
            borders.write.mode("overwrite").parquet(f"{self.folder.root}/_load/borders")
            self.folder.put("_load/plan", json.dumps({"load": uuid.uuid4().hex, "policy": self.policy, "schema": schema.jsonValue(), "keys": self.keys}))
        plan = json.loads(self.folder.get("_load/plan"))
        if (plan["policy"], plan["keys"]) != (self.policy, self.keys):
            raise ValueError(f"a load of {self.folder.root} by policy {plan['policy']} and keys {', '.join(plan['keys'])} has not ended")
        if "begun" not in self.folder.names("_load"):
            # No chunk is in the table yet, so it may be emptied again.
            if self.policy != "insert":
                for name in self._files():
                    self.folder.delete(name)
            self.folder.put("_load/begun", "")
        return plan

    def _files(self) -> list[str]:
        return [n for n in self.folder.names("") if not n.startswith(("_", "."))]

    def _existing(self) -> DataFrame | None:
        return self.spark.read.parquet(self.folder.root) if self._files() else None

    def ledger(self) -> DataFrame:
        """LEDGER_SCHEMA: a row for each chunk of the load under way that is in the table."""
        path = f"{self.folder.root}/_load/ledger"
        return self.spark.read.schema(LEDGER_SCHEMA).json(path) if self.folder.names("_load/ledger") else self.spark.createDataFrame([], LEDGER_SCHEMA)

    def run(self, after: Callable[[int], None] | None = None) -> DataFrame:
        """Load what is left and give the ledger of all chunks. ``after`` is called with the number of each chunk that has been entered there."""
        plan = self._plan()
        borders = self.spark.read.schema(self._border_schema()).parquet(f"{self.folder.root}/_load/borders")
        numbers = borders.select("chunk").unionByName(self.spark.range(1).select(F.col("id").alias("chunk"))).select(F.lit(self.table).alias("table_name"), "chunk")
        todo = sorted(r.chunk for r in pending(numbers, self.ledger()).select("chunk").collect())
        for wave in sorted({c // WAVE for c in todo}):
            self._wave(plan, borders, wave, [c for c in todo if c // WAVE == wave], after)
        told = self.spark.createDataFrame(self.ledger().collect(), LEDGER_SCHEMA)
        self.folder.delete("_stage")
        # The plan goes first: a load that is killed now has ended.
        self.folder.delete("_load/plan")
        self.folder.delete("_load")
        return told

    def _border_schema(self) -> T.StructType:
        return T.StructType([T.StructField("chunk", T.LongType()), T.StructField("key", T.StructType([self.source.schema[k] for k in self.keys]))])

    def _wave(self, plan: dict, borders: DataFrame, wave: int, chunks: list[int], after: Callable[[int], None] | None) -> None:
        started = time.time()
        inner = sorted(borders.filter((F.col("chunk") >= wave * WAVE) & (F.col("chunk") < (wave + 1) * WAVE)).collect())
        end = borders.filter(F.col("chunk") >= (wave + 1) * WAVE).agg(F.min_by("key", "chunk")).first()[0]
        numbers = [*([0] if wave == 0 else []), *[r.chunk for r in inner]]
        fields = self._border_schema()["key"].dataType.fields

        def constant(key: tuple) -> Column:
            return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, key, strict=True)])

        key = F.struct(*self.keys)
        found = borders_until(F.array(*[constant(r.key) for r in inner]), key, WAVE) if inner else F.lit(0)
        number = F.get(F.array(*[F.lit(c).cast("bigint") for c in numbers]), found - (0 if wave == 0 else 1))
        rows = self._within(inner[0].key if wave else None, end).withColumn("_chunk", number).filter(F.col("_chunk").isin(chunks))
        kept = rows if end is None else rows.filter(key < constant(end))
        target = T.StructType.fromJson(plan["schema"])
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields]
        stage = f"_stage/{uuid.uuid4().hex}"
        kept.select(*columns, "_chunk").repartition(len(chunks), "_chunk").write.partitionBy("_chunk").parquet(f"{self.folder.root}/{stage}")
        counts = {r["_chunk"]: r.n for r in self.spark.read.schema("_chunk bigint").parquet(f"{self.folder.root}/{stage}").groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
        mine = self._files()
        for c in chunks:
            prefix = f"{plan['load']}-{c:012}-"
            for name in mine:
                if name.startswith(prefix):
                    self.folder.delete(name)
            parts = [n for n in self.folder.names(f"{stage}/_chunk={c}") if not n.startswith(("_", "."))]
            for k, name in enumerate(parts):
                self.folder.move(f"{stage}/_chunk={c}/{name}", f"{prefix}{k:05}.parquet")
            n = counts.get(c, 0)
            self.folder.put(f"_load/ledger/{c}", json.dumps({"table_name": self.table, "chunk": c, "state": "completed", "rows_done": n, "rows_total": n, "seconds": time.time() - started}))
            if after:
                after(c)
        self.folder.delete(stage)

    def _within(self, low: tuple | None, high: tuple | None) -> DataFrame:
        """The rows that a wave may have: by its outer borders where the key is one column, which files and databases can skip by."""
        rows = self.source
        if len(self.keys) > 1:
            return rows
        key, kind = F.col(self.keys[0]), self.source.schema[self.keys[0]].dataType
        if low is not None and low[0] is not None:
            rows = rows.filter(key >= F.lit(low[0]).cast(kind))
        if high is not None and high[0] is not None:
            below = key < F.lit(high[0]).cast(kind)
            rows = rows.filter(below | key.isNull() if low is None or low[0] is None else below)
        return rows


def load(source: DataFrame, root: str, keys: list[str], chunk_rows: int = 500_000, policy: str = "insert") -> DataFrame:
    """Run a ``ChunkedLoad``, or go on with the one that has not ended, and give its ledger."""
    return ChunkedLoad(source, root, keys, chunk_rows, policy).run()


def _literal(value: object) -> str:
    """A value in SQL; dates and times by the escapes of JDBC, which drivers translate."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, datetime.datetime):
        return f"{{ts '{value.isoformat(sep=' ')}'}}"
    if isinstance(value, datetime.date):
        return f"{{d '{value.isoformat()}'}}"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise ValueError(f"keys of type {type(value).__name__} cannot be borders")


def _beyond(keys: list[str], border: tuple, equal: bool) -> str:
    """Rows whose key is above the border, or equal to it: column by column, as the database compares."""
    parts = []
    for k in range(len(keys)):
        last = k == len(keys) - 1
        sign = ">=" if last and equal else ">"
        parts.append(" AND ".join([*[f"{keys[j]} = {_literal(border[j])}" for j in range(k)], f"{keys[k]} {sign} {_literal(border[k])}"]))
    return "(" + " OR ".join(f"({p})" for p in parts) + ")"


def jdbc_borders(spark: SparkSession, url: str, table: str, keys: list[str], chunk_rows: int, properties: dict | None = None) -> list[tuple]:
    """Every chunk_rows-th key of a table in the database's own order, found by one short query each that begins at the border before.

    Keys on which more than chunk_rows rows fall are one chunk. Keys with a NULL take no part.
    """
    listed, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    borders: list[tuple] = []

    def probe(where: str, skip: int) -> tuple | None:
        rows = spark.read.jdbc(url, f"(SELECT {listed} FROM {table} WHERE {where} ORDER BY {listed} OFFSET {skip} ROWS FETCH NEXT 1 ROWS ONLY) border", properties=properties or {}).collect()
        return tuple(rows[0]) if rows else None

    while True:
        found = probe(f"{known} AND {_beyond(keys, borders[-1], True)}" if borders else known, chunk_rows)
        if found is not None and borders and found == borders[-1]:
            found = probe(f"{known} AND {_beyond(keys, borders[-1], False)}", 0)
        if found is None:
            return borders
        borders.append(found)


def key_predicates(keys: list[str], borders: list[tuple]) -> list[str]:
    """Disjoint conditions that take every row: one for keys with a NULL, and one between each two borders."""
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    parts = ["(" + " OR ".join(f"{k} IS NULL" for k in keys) + ")"]
    for low, high in zip([None, *borders], [*borders, None], strict=True):
        parts.append(" AND ".join([known, *([_beyond(keys, low, True)] if low else []), *([f"NOT {_beyond(keys, high, True)}"] if high else [])]))
    return parts


def read_jdbc_by_key(spark: SparkSession, url: str, table: str, keys: list[str], chunk_rows: int, properties: dict | None = None) -> DataFrame:
    """A table read over JDBC in ranges of a key of any ordered types, one partition for each chunk and one for keys with a NULL.

    Keys are written as the database needs them. Borders and rows are compared by the database alone, so its collation does not matter. They must not be moved while the
    table is read.
    """
    borders = jdbc_borders(spark, url, table, keys, chunk_rows, properties)
    return spark.read.jdbc(url, table, predicates=key_predicates(keys, borders), properties=properties or {})


__all__ = ["ChunkedLoad", "jdbc_borders", "key_predicates", "load", "read_jdbc_by_key"]
