"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chat_format, exact_dedup, filter_audit, html_text, near_dedup, oracle, packing, pii, quality_rules, secret_scan, sharding, token_counts, vector_codes
from ledgerline.llm.staging import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(read(spark, sf_dir, "documents")))


def op3_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op3_secret_scan``, which SQL can express."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", *[f"n_{r.kind}" for r in secret_scan.BASE])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=8)


def op6_shard_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op6_sharding``: sizes and rows in all, shards in use, and whether places have no gaps and loads differ by a document at most."""
    rows = op6_sharding(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.min("slot").alias("first"), F.count_distinct("slot").alias("places"), F.max("size").alias("largest"))
    return shards.agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("shards"),
        F.bool_and((F.col("first") == 0) & (F.col("last") + 1 == F.col("n")) & (F.col("places") == F.col("n"))).alias("gapless"),
        (F.max("bytes") - F.min("bytes") <= 2 * F.max("largest")).alias("even"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed references, as the pipeline has them."""
    rated = quality_rules.rate(read(spark, sf_dir, "documents"))
    return rated.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance", "shape_distance")})


def op7_quality_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from the table itself."""
    rated = quality_rules.rate_relative(read(spark, sf_dir, "documents"))
    return rated.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(read(spark, sf_dir, "documents"), BYTE_BPE))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(read(spark, sf_dir, "documents")))


def op10_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op10_pii``, which SQL can express."""
    return op10_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in pii.KINDS])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_chats(rows.unionByName(chat_format.probe(spark))))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe": op2_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op7_quality_relative": op7_quality_relative,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat_format": op13_chat_format,
    "op3_secret_counts": op3_secret_counts,
    "op6_shard_sums": op6_shard_sums,
    "op10_pii_counts": op10_pii_counts,
}

ORACLE_SQL = oracle.SQL
