"""Which unmatched rows of two tables without a key are the same row with one column changed.

Every unmatched row is hashed with each column left out in turn. Rows of the two sides whose hashes meet differ in that column only. Within such a
group the k-th row of one side is paired with the k-th of the other; places come from ranges over all groups, not from a window, so a
group may be as large as it likes: a table whose only unequal column numbers its rows has a single one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.hashing import column_texts, hashable_columns, row_hash, text_columns
from ledgerline.operators.chunks import position_chunks
from ledgerline.operators.compare import hash_group_diff
from ledgerline.operators.skew import salted_join, split_join
from ledgerline.session import stored


def _surplus(df: DataFrame, other: DataFrame, counts: DataFrame, more: str, less: str, options: dict) -> DataFrame:
    """h, n and the texts of the columns (NULL as NULL) for each distinct row that this side has more often, n times."""
    names = hashable_columns(df, other, exclude=options.get("exclude", ()), float_digits=options.get("float_digits"))
    rest = {k: v for k, v in options.items() if k != "exclude"}
    trim = text_columns(df, other)
    wanted = stored(counts.filter(F.col(more) > F.col(less)).select("h", (F.col(more) - F.col(less)).alias("n")))
    texts = column_texts(df, names, trim, rest.get("compat", True), rest.get("float_digits"))
    rows = df.select(row_hash(df, names, trim=trim, **rest).alias("h"), F.array(*texts).alias("texts"))
    return stored(salted_join(rows, wanted, "h").groupBy("h").agg(F.first("n").alias("n"), F.first("texts").alias("texts")))


def _left_out(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each column: its place k, its value, and the hash ``g`` of k and all other columns."""
    def part(text: Column) -> Column:
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N"))

    parts = F.transform("texts", part)
    others = [F.md5(F.concat_ws("|", F.lit(str(k)), F.slice(parts, 1, k), F.slice(parts, k + 2, len(names)))) for k in range(len(names))]
    one = F.array(*[F.struct(F.lit(k).alias("k"), g.alias("g"), F.get("texts", F.lit(k)).alias("value")) for k, g in enumerate(others)])
    return rows.select("h", "n", "side", F.explode(one).alias("x")).select("h", "n", "side", "x.*")


def _pairs(rows: DataFrame) -> DataFrame:
    """k, source_h, target_h and values of the rows that meet, place by place in their groups; each row at most once for each k."""
    sides = [F.count_if(F.col("side") == side).alias(f"{side}_n") for side in ("source", "target")]
    groups = rows.groupBy("g").agg(*sides).filter("source_n > 0 AND target_n > 0")
    groups = stored(groups.select("g", (F.col("source_n") + F.col("target_n")).alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    meeting = split_join(rows.drop("n"), groups, "g", total)
    placed = stored(position_chunks(meeting, ["g", "side", "h"], 1 << 30))
    starts = stored(placed.groupBy("g").agg(F.min(F.when(F.col("side") == "source", F.col("position"))).alias("source"), F.min(F.when(F.col("side") == "target", F.col("position"))).alias("target"), F.count(F.lit(1)).alias("n")))
    ranked = split_join(placed, starts, "g", total)
    place = F.col("position") - F.when(F.col("side") == "source", F.col("source")).otherwise(F.col("target"))
    ranked = ranked.select("g", "k", "side", "h", "value", place.alias("place"))
    a = ranked.filter("side = 'source'").select("g", "k", "place", F.col("h").alias("source_h"), F.col("value").alias("source_value"))
    b = ranked.filter("side = 'target'").select("g", "place", F.col("h").alias("target_h"), F.col("value").alias("target_value"))
    return a.join(b, ["g", "place"]).drop("g", "place")


def row_changes(source: DataFrame, target: DataFrame, **options) -> DataFrame:
    """source_h, target_h, column_name, source_value, target_value, n: unmatched rows of both sides, those that differ in one column paired.

    h are row hashes over the columns that both sides can hash, n says how many rows. A row without a partner has its own hash only; so has what is left of a
    pair where one side has its row more often. A row that could be paired by several columns is paired by the first in order of their names. Values are canonical texts. Each
    round settles all pairs of at least one column, so there are no more rounds than columns.
    """
    names = hashable_columns(source, target, exclude=options.get("exclude", ()), float_digits=options.get("float_digits"))
    counts = stored(hash_group_diff(source, target, **options))
    sides = [_surplus(a, b, counts, f"{mine}_n", f"{theirs}_n", options).withColumn("side", F.lit(mine)) for a, b, mine, theirs in ((source, target, "source", "target"), (target, source, "target", "source"))]
    rows = sides[0].unionByName(sides[1])
    left, found = stored(_left_out(rows, names)), []
    while True:
        pairs = stored(_pairs(left))
        best = [pairs.groupBy(f"{side}_h").agg(F.min("k").alias("k")) for side in ("source", "target")]
        kept = stored(pairs.join(best[0], ["source_h", "k"]).join(best[1], ["target_h", "k"]))
        if kept.isEmpty():
            break
        found.append(kept)
        done = kept.select(F.lit("source").alias("side"), F.col("source_h").alias("h")).unionByName(kept.select(F.lit("target").alias("side"), F.col("target_h").alias("h")))
        left = stored(left.join(done, ["side", "h"], "left_anti"))
    n = {side: rows.filter(F.col("side") == side).select(F.col("h").alias(f"{side}_h"), F.col("n").alias(f"{side}_n")) for side in ("source", "target")}
    column = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1) if names else F.lit(None).cast("string")
    paired = reduce(DataFrame.unionByName, found or [pairs.limit(0)]).join(n["source"], "source_h").join(n["target"], "target_h").withColumn("n", F.least("source_n", "target_n"))
    out = paired.select("source_h", "target_h", column.alias("column_name"), "source_value", "target_value", "n")
    for side in ("source", "target"):
        used = paired.select(f"{side}_h", F.col("n").alias("used"))
        rest = n[side].join(used, f"{side}_h", "left").select(f"{side}_h", (F.col(f"{side}_n") - F.coalesce("used", F.lit(0))).alias("n")).filter("n > 0")
        out = out.unionByName(rest, allowMissingColumns=True)
    return out
