"""Reports: statuses, statistics, load ledgers, progress and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.canonical import format_duration

REPORT_SCHEMA = "table_name string, mode string, status string, source_rows bigint, target_rows bigint, diff_rows bigint, error string, suggestion string"
LEDGER_SCHEMA = "table_name string, chunk bigint, state string, rows_done bigint, rows_total bigint, seconds double"


def report_stats(report: DataFrame) -> DataFrame:
    """One row: tables, tables of each status, and sums of source, target and differing rows."""
    status = F.col("status")
    return report.agg(
        F.count(F.lit(1)).alias("tables"),
        *[F.count_if(status == s).alias(s) for s in ("pass", "warn", "fail", "skip")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_rows", "target_rows", "diff_rows")],
    )


def overall_status(report: DataFrame) -> DataFrame:
    """One row, status: fail if any table fails, else warn if any warns, else pass."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return report.agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.coalesce(rank, F.lit(0)) + 1).alias("status"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """state and tables for running, completed, failed and pending; every other state is pending."""
    state = F.when(F.col("state").isin("running", "completed", "failed"), F.col("state")).otherwise("pending")
    return ledger.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("tables"))


def load_progress(ledger: DataFrame) -> DataFrame:
    """One row, progress: rows done of rows in total, at most 1; without totals, tables that ended of all tables."""
    by_rows = F.least(F.lit(1.0), F.try_divide(F.sum("rows_done"), F.sum("rows_total")))
    by_tables = F.try_divide(F.count_if(F.col("state").isin("completed", "failed")), F.count(F.lit(1)))
    return ledger.agg(F.coalesce(F.when(F.sum("rows_total") > 0, by_rows), by_tables, F.lit(0.0)).cast("double").alias("progress"))


def load_rates(ledger: DataFrame) -> DataFrame:
    """table_name, rows_per_second, eta_seconds, elapsed for each entry; unknown where nothing has been done."""
    rate = F.try_divide(F.col("rows_done"), F.col("seconds"))
    left = F.greatest(F.col("rows_total") - F.col("rows_done"), F.lit(0))
    return ledger.select("table_name", rate.alias("rows_per_second"), F.try_divide(left, rate).alias("eta_seconds"), format_duration("seconds").alias("elapsed"))


def pending(work: DataFrame, ledger: DataFrame, policy: str = "insert") -> DataFrame:
    """Entries of ``work`` (table_name, chunk) that are not completed or skipped; truncate and drop start over."""
    if policy in ("truncate", "drop"):
        return work
    done = ledger.filter(F.col("state").isin("completed", "skipped")).select("table_name", "chunk").distinct()
    same: Column = (work["table_name"] == done["table_name"]) & work["chunk"].eqNullSafe(done["chunk"])
    return work.join(done, same, "left_anti")


def record(ledger_path: str, entries: DataFrame) -> None:
    """Append entries to the ledger; call it after the data they speak of have been committed."""
    entries.write.mode("append").parquet(ledger_path)


def run_tables(spark: SparkSession, tables: list[str], work: Callable[[str], DataFrame], on_error: str = "skip") -> DataFrame:
    """Reports of ``work(table)``, one table after the other.

    A table that fails gives a row of status fail and its error; with on_error ``abort`` the rest is left
    out, with ``skip`` it goes on.
    """
    report = spark.createDataFrame([], REPORT_SCHEMA)
    for table in tables:
        try:
            rows = work(table).select(*report.columns).collect()
        except Exception as error:  # noqa: BLE001
            rows = [(table, None, "fail", None, None, None, str(error).splitlines()[0], "see the error")]
        report = report.unionByName(spark.createDataFrame(rows, REPORT_SCHEMA))
        if on_error == "abort" and any(r[2] == "fail" for r in rows):
            break
    return report
