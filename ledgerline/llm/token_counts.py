"""Token counts through an exact length histogram.

Documents are aggregated by encoded length, with map-side combining, so what follows has one row for
each distinct length. Suffix sums over the lengths then answer totals, quantiles and truncated totals
for every context limit. They run in two levels (ranges of lengths, then lengths within a range), so
no task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import bpe
from ledgerline.llm.staging import stage

#: Lengths in one range of the two-level sums.
RANGE = 1024


def histogram(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and n_docs: how many rows have each encoded length.

    Null and empty texts count as length 0. Null ids and repeated rows count like all others; an empty
    table has no lengths. Other columns are ignored, and texts are encoded whole.
    """
    return bpe.lengths(docs, path, id_col, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length L as a context limit: n_docs (of that length), docs_from and tokens_from (in
    documents of L tokens or more), truncated_total (tokens left if every document is cut at L),
    lost_tokens, total_docs, total_tokens, and share_within (share of documents of L tokens or less).
    """
    rows = stage(counts.withColumn("range", F.floor(F.col("n_tokens") / RANGE)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    ranges = rows.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    longer = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        rows.join(ranges, "range")
        .withColumn("docs_from", F.col("docs_after") + F.sum("n_docs").over(within))
        .withColumn("tokens_from", F.col("tokens_after") + F.sum(tokens).over(within))
    )
    truncated = F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        truncated.alias("truncated_total"),
        (F.col("total_tokens") - truncated).alias("lost_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("share_within"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least that share of the documents stays within."""
    picks = [F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)]
    pairs = [F.struct(F.lit(q).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(shares)]
    return sums.agg(*picks).select(F.inline(F.array(*pairs)))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, limit and tokens: what is left of the corpus if every document is cut at any limit, also between lengths."""
    above = sums.filter(F.col("n_tokens") > limit)
    cut = above.agg(F.coalesce(F.sum(F.col("n_docs") * (F.col("n_tokens") - limit)), F.lit(0)).alias("lost"), F.lit(1).alias("one"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), F.lit(1).alias("one"))
    return total.join(cut, "one").select(F.lit(limit).cast("long").alias("limit"), (F.col("total") - F.col("lost")).alias("tokens"))
