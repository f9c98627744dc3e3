"""Audit of filters that are applied one after the other: what each removes, and what it would have removed anyway.

Every filter has a table of the ids of rows that fail it. All prefixes of all orders are subsets of the
filters, so the rows are paired with the 2^k subsets, and joins with the id tables on the row's id decide:
a left-anti join leaves the survivors of each subset; failing rows with subsets that lack their filter
are removed there if a left-anti join leaves them, and redundant if a left-semi join does. A row meets at most k rows
of the id tables, so no key is hot, and the joins share one shuffle of ids; texts are read once and not shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.skew import salted_join, split_join
from ledgerline.llm.staging import stage

#: White space between words, as ``translate`` takes it.
SPACES = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Maximal runs of characters that are no white space of ASCII."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def short(text: Column, found: Column) -> Column:
    return F.size(found) < 100


def repetitive(text: Column, found: Column) -> Column:
    return 100 * F.size(F.array_distinct(found)) < 80 * F.size(found)


def shouting(text: Column, found: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text)


def symbols(text: Column, found: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions over a text and its words. COPIES, which needs the whole table, joins them as the last filter.
RULES: dict[str, Callable[[Column, Column], Column]] = {"A": short, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"

KEPT, REMOVED, REDUNDANT, SHAPLEY = range(4)


def _label_flags(labels: DataFrame) -> DataFrame:
    flags = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flags.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]).filter("good OR toxic")


def id_tables(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column, Column], Column]] = RULES, copies: str = COPIES) -> tuple[DataFrame, DataFrame]:
    """(rows, fails): every row by its number ``row`` with part, good, toxic; and for each filter the rows that fail it.

    ``fails`` is stored in one folder for each filter, with the column ``filter``. The number of a row is given once, when
    the rows are stored; so rows that share a doc_id, or have none, are told apart.
    """
    text, found = F.coalesce("text", F.lit("")), F.col("_words")
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("_words", words(F.col("text")))
    failed = F.array_compact(F.array(*[F.when(rule(F.col("text"), found), name) for name, rule in rules.items()]))
    judged = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed"))
    flagged = salted_join(judged, stage(_label_flags(labels), "audit-labels"), "doc_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = stage(flagged.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "digest", "failed", *flags), "audit-rows")
    groups = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = split_join(rows.filter("doc_id IS NOT NULL"), stage(groups, "audit-copies"), "digest", rows.count()).filter(F.col("doc_id") > F.col("first"))
    kept = ("row", "part", "good", "toxic")
    fails = rows.select(*kept, F.explode("failed").alias("filter")).unionByName(later.select(*kept, F.lit(copies).alias("filter")))
    return rows.select(*kept), stage(fails, "audit-ids", by=("filter",))


def prefix_counts(rows: DataFrame, fails: DataFrame, names: str) -> DataFrame:
    """part, kind, bit, prefix and the counts n, good, toxic.

    prefix is a set of filters as bits. KEPT: rows that fail none of them (bit 0). REMOVED and REDUNDANT: rows
    that fail the filter ``bit`` outside of the prefix, and none or some of those in it.
    """
    bits = F.coalesce(*[F.when(F.col("filter") == name, 1 << k) for k, name in enumerate(names)])
    failing = fails.select("row", "part", "good", "toxic", bits.alias("bit"))
    by_row = failing.select(F.col("row").alias("_row"), F.col("bit").alias("_bit")).repartition("_row")
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("prefix")
    # Dealt out by row before they are paired with prefixes: the pairs are not shuffled.
    pairs = rows.repartition("row").select("*", every).withColumn("bit", F.lit(0))
    candidates = failing.repartition("row").select("*", every).filter(F.col("prefix").bitwiseAND(F.col("bit")) == 0)
    met = (F.col("row") == F.col("_row")) & (F.col("prefix").bitwiseAND(F.col("_bit")) != 0)

    def count(found: DataFrame, kind: int) -> DataFrame:
        sums = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
        return found.groupBy("part", "bit", "prefix").agg(*sums).withColumn("kind", F.lit(kind))

    survivors = count(pairs.join(by_row, met, "left_anti"), KEPT)
    removed = count(candidates.join(by_row, met, "left_anti"), REMOVED)
    redundant = count(candidates.join(by_row, met, "left_semi"), REDUNDANT)
    return survivors.unionByName(removed).unionByName(redundant)


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column, Column], Column]] = RULES, copies: str = COPIES) -> DataFrame:
    """One row for each part (value of lang), order of the filters and step: what the step's filter does there.

    part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley;
    the last is the sum of the filter's removals over all orders. Rules are named by single letters, a handful at most, as
    all orders are listed.

    Null texts count as empty, null languages as ``''``. A row is a copy if its text is that of a row with a smaller
    doc_id; rows without an id are no copies, nor do others become copies by them. Rows that share
    an id are counted apart. Where a document has several labels, any with quality 1, or toxic 1, counts; null labels and
    labels of unknown documents do not. Texts of any length are read whole. Tables without rows give none. Other
    columns are ignored, whatever their names.
    """
    names = "".join([*rules, copies])
    counts = stage(prefix_counts(*id_tables(docs, labels, rules, copies), names), "audit-counts")
    size = len(names)
    weights = F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)])
    share = F.col("n") * F.element_at(weights, F.bit_count("prefix") + 1)
    shapley = counts.filter(F.col("kind") == REMOVED).groupBy("part", "bit").agg(F.sum(share).alias("n"))
    shapley = shapley.select("part", "bit", "n", F.lit(0).alias("prefix"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"), F.lit(SHAPLEY).alias("kind"))

    def place(kind: int, bit: Column, prefix: Column) -> Column:
        return (F.lit(kind) * (1 << size) + bit) * (1 << size) + prefix

    entry = F.struct(place(0, F.col("bit"), F.col("prefix")) + F.col("kind") * (1 << 2 * size), F.struct("n", "good", "toxic"))
    # At most 2^k + k 2^k + k entries a part, whatever the rows.
    parts = counts.unionByName(shapley).groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    orders = parts.select("part", "found", F.explode(_steps(names)).alias("s")).select("part", "found", "s.*")

    def told(kind: int, bit: Column, prefix: Column, what: str = "n") -> Column:
        return F.coalesce(F.col("found")[place(kind, bit, prefix)][what], F.lit(0).cast("bigint"))

    bit, before, others = F.col("bit"), F.col("before"), F.lit((1 << size) - 1) - F.col("bit")
    return orders.select(
        "part",
        "filter_order",
        "step",
        told(KEPT, F.lit(0), before + bit).alias("kept"),
        told(REMOVED, bit, before).alias("removed"),
        told(REDUNDANT, bit, before).alias("redundant"),
        told(REMOVED, bit, others).alias("unique_fails"),
        told(REMOVED, bit, before, "good").alias("good_lost"),
        told(REMOVED, bit, before, "toxic").alias("toxic_lost"),
        told(SHAPLEY, bit, F.lit(0)).alias("shapley"),
    )


def _steps(names: str) -> Column:
    """All steps of all orders, as one constant: the step's filter as a bit, and those before it."""
    bit = {name: 1 << k for k, name in enumerate(names)}
    steps = []
    for order in permutations(names):
        for k, name in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "bit": bit[name], "before": sum(bit[x] for x in order[:k])})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
