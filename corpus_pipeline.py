"""The corpus pipeline: quality rules, near-duplicates, repeated passages,
mixing, tokens. Every stage takes all that the one before kept.

All stages but the last keep the columns of documents, whatever further ones there are
and however they are called. An empty table gives an empty result. What nulls, empty
texts and repeated rows become is said at each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import lsh_forest, mixing, prefix_bpe, quality, substring_dedup
from siftline.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and so do null and empty texts, which have
    too few words; repeated rows are judged one by one."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays (similarity 0.8 of 5-word shingles), that of the
    smallest doc_id; a repeated row stays once. Rows without a doc_id, which no group
    can be named by, stay once for each text that no other row has."""
    return lsh_forest.keep_one(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of a smaller doc_id has are taken
    out, and documents of which nothing is left go; rows without a doc_id lose nothing."""
    return substring_dedup.remove(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own, and
    texts without words are not taken."""
    return mixing.take(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null: none), beside the columns of documents."""
    return prefix_bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("source_mix", source_mix), ("byte_bpe", byte_bpe),
]

#: The later stages can't be said in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
