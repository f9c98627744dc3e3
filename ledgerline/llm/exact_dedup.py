"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z; they are compared by SHA-256. A frequent-items
sketch (Misra-Gries family, ``approx_top_k``) over a fixed number of hash buckets proposes frequent
digests; their exact counts and winners are computed with map-side combining and broadcast (at most
``BUCKETS * PER_BUCKET`` rows, whatever the input). Everything else takes one ordinary shuffle. The
sketch only decides the route of a row, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.staging import stage

#: Bound of the broadcast: so many hash buckets, with so many candidates kept and tracked in each.
BUCKETS, PER_BUCKET, TRACKED = 64, 16, 256
#: A verified digest counts as frequent from so many rows on.
FREQUENT = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_case(text: Column) -> Column:
    """Null as empty; A-Z in lower case, all else unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest(text: Column) -> Column:
    return F.sha2(fold_case(text), 256)


def frequent_digests(digests: DataFrame) -> DataFrame:
    """Candidates for frequent digests, at most BUCKETS * PER_BUCKET rows."""
    return (
        digests.groupBy(F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket"))
        .agg(F.expr(f"approx_top_k(digest, {PER_BUCKET}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("top"))
        .select(F.col("top.item").alias("digest"))
    )


def frequent_winners(digests: DataFrame) -> DataFrame:
    """Exact size and winner (largest doc_id, then row number) of each frequent digest."""
    return (
        digests.join(F.broadcast(frequent_digests(digests)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= FREQUENT)
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts is kept. Null texts count as empty and
    equal each other and ``''``. Null ids rank below all others; a group with null ids alone has a
    null keep_id. Of repeated rows (same id, same text) exactly one is kept. Empty tables give no
    rows; other columns are ignored, whatever their names. Texts of any length are hashed whole.
    """
    digests = stage(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    winners = F.broadcast(stage(frequent_winners(digests), "winners"))
    hot = digests.join(winners, "digest")
    rest = digests.join(winners, "digest", "left_anti")
    # Counted with map-side combining and joined back, so that Spark can split what the sketch has left.
    groups = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    cold = rest.join(groups, "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the largest id.

    Null texts count as empty and equal each other and ``''``. Null ids rank below all others. Rows of one
    id whose texts differ in case are told apart by the hash of the text as it stands, so the result does
    not depend on the order of rows; of rows equal in id and text any one stays. Empty tables give no rows;
    columns of any names may be there. Texts of any length are hashed whole. Losers among frequent digests
    go on the map side, before any shuffle; the rest meets once per digest.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs[id_col].alias("id"), digest(docs[text_col]).alias("digest"), F.xxhash64(docs[text_col]).alias("spelt"))
    digests = stage(rows.select(F.col("id").alias("doc_id"), "digest", F.col("spelt").alias("row")), "digests")
    winners = stage(frequent_winners(digests).select(F.col("digest").alias("hot"), F.col("winner").alias("best")), "winners")
    best = F.col("id").eqNullSafe(F.col("best.doc_id")) & (F.col("spelt") == F.col("best.row"))
    left = rows.join(F.broadcast(winners), F.col("digest") == F.col("hot"), "left").filter(F.col("hot").isNull() | best)
    # Of rows that repeat, each task sends one: Spark limits the groups of a first row number before they are shuffled.
    first = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last(), F.col("spelt").desc())
    return left.withColumn("place", F.row_number().over(first)).filter(F.col("place") == 1).select("doc.*")
