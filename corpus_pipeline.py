"""A corpus pipeline over ``documents``: quality rules, exact dedup, near dedup, personal data, packing.

Every stage reads what its predecessor kept and hands on the same columns; the last returns the packed
pieces. A stage's result must be stored before the next stage is built: building a stage deletes the
intermediate tables of this pipeline's stages before it, and no others.

All stages take empty tables (and give none, or no pieces), rows with null ids, null, empty and very long
texts, repeated rows, and further columns of any names, which all but the last hand on. What each does with
them is said below.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exact_dedup, near_dedup, packing, pii, quality_rules, staging
from ledgerline.llm.queries import WORD_BPE

_before: list[staging.Scope] = []


@contextmanager
def _alone(spark: SparkSession) -> Iterator[None]:
    """Delete what the stages before have left, and remember what this one writes."""
    while _before:
        _before.pop().clear(spark)
    with staging.scope() as own:
        _before.append(own)
        yield


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Each row is judged by itself against fixed references, so
    repeated rows and ties fare alike; a null or unknown language takes the nearest reference.
    """
    with _alone(spark):
        return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z in lower case): that of the largest id.

    Null texts count as empty and equal each other and empty ones. Null ids rank below all others; rows of one
    id are told apart by their spelling, and of rows equal in id and text one stays.
    """
    with _alone(spark):
        return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    The smallest id stays; null ids rank above all others, rows of one id are told apart by their text, and of
    rows equal in both one stays. Null and empty texts, and those of white space, have no shingles and all stay.
    """
    with _alone(spark):
        return near_dedup.drop_near_copies(docs, words=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it replaced by their kind or shape.

    Null and empty texts stay as they are. Ids play no part; rows of one text are masked alike.
    """
    with _alone(spark):
        return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    Null and empty texts are documents of one id. Rows with null ids and repeated rows are packed one by one; ties
    on the curve are broken by the row.
    """
    with _alone(spark):
        return packing.pack(docs, WORD_BPE)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("pack", pack)]

#: Word histograms, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before are stored in the shared folder and read again, each as long as it is needed."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        built = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return built
        older = path
        docs, path = staging.store(built, name)
        if older is not None:
            staging.delete(spark, older)
