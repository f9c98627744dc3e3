"""Change feeds as streams: sources, a versioned sink of many tables, and what monitoring asks of them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ledgerline.operators.digests import digest_of, digest_sums
from ledgerline.sources.folders import Folder
from ledgerline.streaming.alters import Alter, alter, parse_alters
from ledgerline.streaming.changes import (
    INTERNAL,
    RAW_SCHEMA,
    apply_changes,
    conform_events,
    decode_changes,
    holdings,
    misfit_reason,
    resolve,
    row_text,
    structural_reason,
    with_keys,
)


def read_changes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of events from JSON files of RAW_SCHEMA, decoded."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return decode_changes(reader.json(path))


#: Types of stored sums of row hashes.
SUM_TYPES = {"n": "bigint", "s1": "decimal(38,0)", "s2": "decimal(38,0)", "s3": "decimal(38,0)"}


class VersionedTable(Folder):
    """A Parquet table in hash buckets of its key. A version writes the buckets it changes and lists all.

    The list of a version is put in place by a rename once its files are complete, so a reader sees a whole
    version. A version that is listed is never written again, so a batch that runs again counts once. The
    last ``keep`` versions stay readable; older files are deleted. The number of buckets is fixed when the
    table is made and bounds both the list and the files of a batch.

    With ``digests``, the options of row hashes (``{}`` for none), each version carries the order-free sums of its row hashes, so that ``digest`` is that of
    ``table_digest`` without a scan. A batch takes the old rows of the buckets it touches out of the sums, and adds the new ones.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64, keep: int = 2, digests: dict | None = None) -> None:
        super().__init__(spark, root)
        self.keys, self.buckets, self.keep, self.digests = list(keys), buckets, keep, digests

    def bucket_of(self, text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions that can be read, in order."""
        return self.numbers("versions")

    def _listed(self, version: int) -> dict:
        return json.loads(self.get(f"versions/{version}"))

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The latest version, or the latest before one; None where there is none. ``buckets`` reads only these."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return None
        return self._rows(self._listed(known[-1]), buckets)

    def write(self, df: DataFrame, version: int, touched: list[int] | None = None) -> None:
        """Store a version: all rows, or those of the buckets ``touched``, while the others stay as they are."""
        if version in self.versions():
            return
        schema = df.schema.jsonValue()
        df.withColumn("_bucket", self.bucket_of(row_text(df, self.keys))).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/data/{version}")
        older = [v for v in self.versions() if v < version]
        there = self._listed(older[-1])["buckets"] if older and touched is not None else {}
        there = {b: v for b, v in there.items() if int(b) not in touched}
        there |= {n.partition("=")[2]: version for n in self.names(f"data/{version}") if n.startswith("_bucket=")}
        listed = {"schema": schema, "buckets": there}
        if self.digests is not None:
            self._write_sums(df.schema, version, older[-1] if older else None, touched, listed)
        self.put(f"versions/{version}", json.dumps(listed))
        self._clean()

    def _rows(self, listed: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(listed["schema"])
        paths = [f"{self.root}/data/{v}/_bucket={b}" for b, v in listed["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_sums(self, schema: T.StructType, version: int, before: int | None, touched: list[int] | None, listed: dict) -> None:
        old = self._listed(before) if before is not None else None
        listed["digests"] = self.digests
        goes_on = old is not None and touched is not None and old.get("digests") == self.digests and old["schema"] == schema.jsonValue()
        sums = digest_sums(self._rows(listed, touched if goes_on else None), **self.digests)
        if goes_on:
            out = digest_sums(self._rows(old, touched), **self.digests)
            signed = out.select("bucket", *[(-F.col(c)).alias(c) for c in ("n", "s1", "s2", "s3")])
            both = self._sums(before).unionByName(sums.select(*self._sums(before).columns)).unionByName(signed)
            sums = both.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3")]).filter("n <> 0")
        # A row for each bucket of hashes, however large the table.
        kept = sums.select("bucket", *[F.col(c).cast(k).alias(c) for c, k in SUM_TYPES.items()]).coalesce(1)
        kept.write.mode("overwrite").parquet(f"{self.root}/digests/{version}")

    def _sums(self, version: int) -> DataFrame:
        return self.spark.read.schema("bucket bigint, " + ", ".join(f"{c} {k}" for c, k in SUM_TYPES.items())).parquet(f"{self.root}/digests/{version}")

    def digest(self, version: int | None = None) -> DataFrame:
        """n_rows and digest of a version, the latest if none is named, from its sums alone."""
        known = [v for v in self.versions() if "digests" in self._listed(v) and version in (None, v)]
        if not known:
            raise ValueError(f"no digest of version {version} of {self.root}")
        return digest_of(self._sums(known[-1]))

    def _clean(self) -> None:
        versions = self.versions()
        kept = versions[-self.keep :]
        used = {(str(v), f"_bucket={b}") for k in kept for b, v in self._listed(k)["buckets"].items()}
        for v in versions[: -self.keep]:
            self.delete(f"versions/{v}")
            self.delete(f"digests/{v}")
        for v in self.names("data"):
            if int(v) > kept[-1]:
                continue
            names = [n for n in self.names(f"data/{v}") if n.startswith("_bucket=")]
            for n in names:
                if (v, n) not in used:
                    self.delete(f"data/{v}/{n}")
            if not any((v, n) in used for n in names):
                self.delete(f"data/{v}")


def _looked_at(table: VersionedTable, events: DataFrame, base: DataFrame, max_length: int) -> Row:
    """What a table's events hold (``holdings``), the first misfit, and the buckets they touch: one job."""
    schema, keys = base.schema, resolve(base.schema, table.keys)
    conformed = conform_events(events, schema)
    reason = F.nullif(misfit_reason(schema, keys, max_length), F.lit(""))
    keyed = with_keys(conformed.withColumn("_reason", reason), schema, keys, max_length)
    buckets = F.collect_set(F.when(F.col("kind").isin("insert", "update", "delete"), table.bucket_of(F.col("row_key"))))
    moved_to = F.collect_set(F.when(F.col("kind") == "update", table.bucket_of(F.col("to_key"))))
    # At most as many entries as the table has buckets.
    return keyed.agg(*holdings(keys), F.min("_reason").alias("misfit"), F.array_union(buckets, moved_to).alias("touched")).first()


def fold_batch(table: VersionedTable, events: DataFrame, version: int, on_conflict: str = "replace", max_length: int = 0, looked_at: Row | None = None) -> None:
    """The next version of a table, from the events of one batch; only buckets that hold a touched key are read and written."""
    if version in table.versions():
        return
    base = table.read(before=version)
    held = looked_at or _looked_at(table, events, base, max_length)
    if held.truncates:
        table.write(apply_changes(base, events, table.keys, on_conflict, max_length, held), version)
    else:
        table.write(apply_changes(table.read(before=version, buckets=held.touched), events, table.keys, on_conflict, max_length, held), version, held.touched)


def _segments(table: VersionedTable, events: DataFrame, base: DataFrame) -> list[tuple[DataFrame, list[Alter]]]:
    """A table's events cut at its column changes: those of each segment, and the changes after it. Changes of columns are few, and come to the driver."""
    told = events.filter("kind = 'ddl' AND ddl IS NOT NULL").select("lsn", "ordinal", "ddl").orderBy("lsn", "ordinal").collect()
    at, out, low = F.struct("lsn", "ordinal"), [], None
    for r in told:
        changes = parse_alters(r.ddl)
        if changes:
            high = F.struct(F.lit(r.lsn).cast("bigint").alias("lsn"), F.lit(r.ordinal).cast("int").alias("ordinal"))
            out.append((events.filter(at < high if low is None else (at > low) & (at < high)), changes))
            low = high
    return [*out, (events if low is None else events.filter(at > low), [])]


def fold_altered(table: VersionedTable, events: DataFrame, version: int, on_conflict: str = "replace", max_length: int = 0) -> None:
    """``fold_batch`` for events among which columns are added, dropped or renamed: each row event counts by the columns its table had at its place.

    Only columns without a default can be added without writing all buckets. The version carries the new schema.
    """
    if version in table.versions():
        return
    shape = table.read(before=version)
    segments, looked = _segments(table, events, shape), []
    for part, changes in segments:
        seen = _looked_at(table, part, shape, max_length)
        if seen.misfit is not None:
            raise ValueError(f"{seen.misfit} in an event of {table.root}")
        looked.append(seen)
        for change in changes:
            shape = alter(shape, change, table.keys)
    whole = any(seen.truncates for seen in looked) or any(c.rewrites for _, changes in segments for c in changes)
    touched = None if whole else sorted({b for seen in looked for b in seen.touched})
    rows = table.read(before=version, buckets=touched)
    for (part, changes), seen in zip(segments, looked, strict=True):
        rows = apply_changes(rows, part, table.keys, on_conflict, max_length, seen)
        for change in changes:
            rows = alter(rows, change, table.keys)
    table.write(rows, version, touched)


def _in_pools(spark: SparkSession, parallel: int, work: Callable[[str], object], names: Iterable[str]) -> dict:
    """``work`` for each name by a bounded number of threads, each of which has a scheduler pool of its own; the first error is raised once all have ended."""
    context = spark.sparkContext
    inherited = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

    def run(place: int, name: str) -> object:
        for k, v in inherited.items():
            context.setLocalProperty(k, v)
        context.setLocalProperty("spark.scheduler.pool", f"ledgerline-{place % parallel}")
        try:
            return work(name)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=parallel) as threads:
        tasks = {name: threads.submit(run, k, name) for k, name in enumerate(names)}
    return {name: task.result() for name, task in tasks.items()}


def apply_batch(
    tables: dict[str, VersionedTable], state: str, on_conflict: str = "replace", inventory: DataFrame | None = None, max_held: int = 10, parallel: int = 4, max_length: int = 0
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds each batch's events into the next version of each table that they touch.

    tables are by lower-case name, with or without its schema. The batch is stored once, in a folder for each table, so what a table costs depends
    on its own events; tables without events are not looked at and get no version. ``parallel`` tables are folded at a time, each in a scheduler pool
    of its own. Structural errors, values that do not fit their column, columns that a table does not have, and key columns without a value stop the
    stream before any table of the batch is written; where columns change within the batch (``fold_altered``), before any table whose columns do not. Events of tables outside of the inventory are held back in the folder ``state``, which outlives the
    process, and are tried again with each batch; those that have waited for max_held batches stop it as well. Events of tables in the inventory that
    are not among ``tables`` are not applied, but counted: each batch leaves a line of counters in ``state`` (``counters``), which are taken from
    the stored batch and so count each event once, whatever tasks run again.
    """
    names = list(tables)
    targets = F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name.lower()), F.lit(k))]) if tables else F.create_map().cast("map<string,int>")
    to = F.coalesce(targets[F.lower(F.concat_ws(".", "schema", "table"))], targets[F.lower("table")], F.lit(UNLISTED))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, started, version = batch.sparkSession, time.time(), batch_id + 1
        folder = Folder(spark, state)
        events = batch.withColumn("_held_since", F.lit(batch_id).cast("long"))
        earlier = [n for n in folder.numbers("held") if n < batch_id]
        if earlier:
            events = events.unionByName(spark.read.schema(events.schema).parquet(f"{folder.root}/held/{earlier[-1]}"))
        events = _sorted_out(folder, events, to, inventory, batch_id)
        part = f"{folder.root}/_batch-{batch_id}"
        events.write.mode("overwrite").partitionBy("_to").parquet(part)
        schema = events.drop("_to").schema
        new = F.col("_held_since") == batch_id
        counts = spark.read.schema(events.schema).parquet(part).groupBy("_to").agg(F.count(F.lit(1)).alias("n"), F.count_if(new).alias("new"), F.max(F.when(new, F.struct("lsn", "ordinal"))).alias("position"), F.count_if((F.col("kind") == "ddl") & F.col("ddl").isNotNull()).alias("alters"))
        # A row for each table that the batch touches.
        there = {r["_to"]: r for r in counts.collect()}

        def own(k: int) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{part}/_to={k}")

        if FAILED in there:
            first = own(FAILED).withColumn("reason", structural_reason()).first()
            raise ValueError(f"batch {batch_id}: {first['reason']} in an event of {first['schema']}.{first['table']}")
        if inventory is not None and batch_id not in folder.numbers("held"):
            _hold(folder, own(HELD) if HELD in there else spark.createDataFrame([], schema), batch_id, max_held)
        todo = [k for k in sorted(there) if k >= 0 and version not in tables[names[k]].versions()]
        altered = {k for k in todo if there[k]["alters"]}
        found = _in_pools(spark, parallel, lambda k: _looked_at(tables[names[k]], own(k), tables[names[k]].read(before=version), max_length), [k for k in todo if k not in altered])
        for k, looked_at in found.items():
            if looked_at.misfit is not None:
                raise ValueError(f"batch {batch_id}: {looked_at.misfit} in an event of {names[k]}")

        def fold(k: int) -> None:
            if k in altered:
                fold_altered(tables[names[k]], own(k), version, on_conflict, max_length)
            else:
                fold_batch(tables[names[k]], own(k), version, on_conflict, max_length, found[k])

        # Those whose columns change may still stop the batch; they go before all others.
        _in_pools(spark, parallel, fold, sorted(altered))
        _in_pools(spark, parallel, fold, [k for k in todo if k not in altered])
        _count(folder, batch_id, started, there)
        folder.delete(f"_batch-{batch_id}")

    return run


#: Where events go that belong to none of the tables.
FAILED, HELD, UNLISTED, RESERVED = -1, -2, -3, -4


def _sorted_out(folder: Folder, events: DataFrame, to: Column, inventory: DataFrame | None, batch_id: int) -> DataFrame:
    """Events with ``_to``: the number of their table, or one of OTHERS. A batch that runs again holds back what it did, also if the inventory is another by then."""
    to = F.when(F.lower("table").isin(*INTERNAL), RESERVED).when(structural_reason().isNotNull(), FAILED).when(F.col("_waits"), HELD).otherwise(to)
    if inventory is None:
        return events.withColumn("_waits", F.lit(False)).withColumn("_to", to).drop("_waits")
    if batch_id in folder.numbers("held"):
        held = folder.spark.read.schema(events.schema).parquet(f"{folder.root}/held/{batch_id}").select("lsn", "ordinal", F.lit(True).alias("_waits"))
        marked = events.join(held, ["lsn", "ordinal"], "left").select(*events.columns, F.coalesce("_waits", F.lit(False)).alias("_waits"))
    else:
        known = inventory.select(F.lower("schema").alias("_s"), F.lower("table").alias("_t"), F.lit(False).alias("_waits")).distinct()
        marked = events.join(known, (F.lower("schema") == F.col("_s")) & (F.lower("table") == F.col("_t")), "left").select(*events.columns, F.coalesce("_waits", F.lit(True)).alias("_waits"))
    return marked.withColumn("_to", to).drop("_waits")


def _hold(folder: Folder, unknown: DataFrame, batch_id: int, max_held: int) -> None:
    """Store the events that are held back for the next batch."""
    first = unknown.agg(F.min("_held_since")).first()[0]
    if first is not None and batch_id - first >= max_held:
        raise ValueError(f"batch {batch_id}: events of an unknown table have waited for {max_held} batches")
    unknown.write.mode("overwrite").parquet(f"{folder.root}/_held-{batch_id}")
    folder.move(f"_held-{batch_id}", f"held/{batch_id}")
    for k in folder.numbers("held"):
        if k < batch_id - 1:
            folder.delete(f"held/{k}")


#: Sums over all batches: received from the stream, of these internal; applied, in the inventory but not among the tables, and held back, an event once a batch.
COUNTS = ("received", "internal", "applied", "unlisted", "held")
COUNTER_SCHEMA = "batch bigint, batches bigint, tables int, lsn bigint, ordinal int, first double, started double, updated double, " + ", ".join(f"{c} bigint" for c in COUNTS)
#: Lines of counters that are kept, one for each batch.
KEPT_LINES = 100


def _count(folder: Folder, batch_id: int, started: float, there: dict[int, Row]) -> None:
    """The line of counters of a batch, which goes on from the line before it."""
    before = [n for n in folder.numbers("counters") if n < batch_id]
    last = json.loads(folder.get(f"counters/{before[-1]}")) if before else {}
    lsn, ordinal = max((tuple(r["position"]) for r in there.values() if r["position"]), default=(last.get("lsn"), last.get("ordinal")))
    here = {name: there[k]["n"] if k in there else 0 for k, name in ((RESERVED, "internal"), (UNLISTED, "unlisted"), (HELD, "held"))}
    here |= {"received": sum(r["new"] for r in there.values()), "applied": sum(r["n"] for k, r in there.items() if k >= 0)}
    line = {"batch": batch_id, "batches": last.get("batches", 0) + 1, "tables": sum(k >= 0 for k in there), "lsn": lsn, "ordinal": ordinal, "first": last.get("first", started), "started": started, "updated": time.time()}
    folder.put(f"counters/{batch_id}", json.dumps(line | {c: last.get(c, 0) + here[c] for c in COUNTS}))
    for n in before[: -KEPT_LINES + 1]:
        folder.delete(f"counters/{n}")


class Heartbeats(StreamingQueryListener):
    """Writes a line for a query whenever it starts, makes progress, idles or ends, in place of the one before."""

    def __init__(self, spark: SparkSession, state: str, name: str) -> None:
        self.folder, self.name, self.id = Folder(spark, state), name, None

    def _beat(self, event: object, alive: bool = True, halted: bool = False) -> None:
        if str(event.id) == self.id:
            self.folder.put(f"beats/{event.runId}", json.dumps({"run": str(event.runId), "halted": halted, "process_alive": alive, "updated": time.time()}))

    def onQueryStarted(self, event: object) -> None:
        if event.name == self.name:
            self.id = str(event.id)
            self._beat(event)

    def onQueryProgress(self, event: object) -> None:
        self._beat(event.progress)

    def onQueryIdle(self, event: object) -> None:
        self._beat(event)

    def onQueryTerminated(self, event: object) -> None:
        self._beat(event, alive=False, halted=event.exception is not None)


def counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Lines of the last batches of a feed that ``start`` ran, COUNTER_SCHEMA."""
    return spark.read.schema(COUNTER_SCHEMA).json(f"{_state(checkpoint)}/counters")


def feed_metrics(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``stream_metrics`` of a feed and its position: batches, lsn, ordinal, lag, events_per_second, uptime_seconds. No row before the first batch."""
    last = counters(spark, checkpoint).agg(F.max_by(F.struct("*"), "batch").alias("c")).filter("c IS NOT NULL").select("c.*")
    left = last.withColumn("applied", F.col("applied") + F.col("internal") + F.col("unlisted"))
    told = left.select("batches", "lsn", "ordinal", "received", "applied", F.timestamp_seconds("first").alias("started"), F.timestamp_seconds("updated").alias("now"))
    return stream_metrics(told, "batches", "lsn", "ordinal")


def feed_state(spark: SparkSession, checkpoint: str, now: Column | None = None, stale_after: int = 30) -> DataFrame:
    """``liveness`` of each run of a feed by the heartbeats of its query: run, halted, process_alive, updated, state."""
    beats = spark.read.schema("run string, halted boolean, process_alive boolean, updated double").json(f"{_state(checkpoint)}/beats")
    return liveness(beats.withColumn("updated", F.timestamp_seconds("updated")), now, stale_after)


def _state(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/ledgerline"


def start(
    events: DataFrame, tables: dict[str, VersionedTable], checkpoint: str, on_conflict: str = "replace", available_now: bool = False, interval: str = "5 seconds", inventory: DataFrame | None = None, parallel: int = 4, max_length: int = 0
) -> StreamingQuery:
    """Run ``apply_batch`` over a stream; held events, counters and heartbeats are kept beside its checkpoint. A table's version 0 is the snapshot that the feed continues."""
    spark, name = events.sparkSession, f"ledgerline-{uuid.uuid4().hex}"
    run = apply_batch(tables, _state(checkpoint), on_conflict, inventory, parallel=parallel, max_length=max_length)
    spark.streams.addListener(Heartbeats(spark, _state(checkpoint), name))
    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def stream_metrics(progress: DataFrame, *more: str) -> DataFrame:
    """lag (received less applied, at least 0), events_per_second and uptime_seconds from counters (received, applied, started, now), and the columns ``more``."""
    seconds = F.col("now").cast("double") - F.col("started").cast("double")
    return progress.select(
        *more, F.greatest(F.col("received") - F.col("applied"), F.lit(0)).alias("lag"), F.try_divide(F.col("applied").cast("double"), seconds).alias("events_per_second"), seconds.alias("uptime_seconds")
    )


def liveness(status: DataFrame, now: Column | None = None, stale_after: int = 30) -> DataFrame:
    """A heartbeat table (halted, process_alive, updated) with ``state``.

    halted wins over all; a heartbeat older than stale_after seconds, or a process that is gone, is stale;
    no heartbeat is not_running.
    """
    now = F.current_timestamp() if now is None else now
    age = now.cast("double") - F.col("updated").cast("double")
    state = (
        F.when(F.col("updated").isNull(), "not_running")
        .when(F.coalesce("halted", F.lit(False)), "halted")
        .when((age > stale_after) | ~F.coalesce("process_alive", F.lit(True)), "stale")
        .otherwise("running")
    )
    return status.withColumn("state", state)
