"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import (
    ann, group_join, lsh_forest, mixing, prefix_bpe, prefix_trie, quality, sharding, spelling, substring_dedup, token_counts, token_files,
    toxicity,
)
from siftline.llm.common import Query, table
from siftline.session import shared_folder

SHARDS = 8


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign_shards(table(spark, sf_dir, "documents"), weights=(1.0,) * SHARDS)
    return sharding.with_slots(assigned).withColumn("law", F.lit("key"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id")) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path, digest=True).withColumnRenamed("key", "doc_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents")).drop("removed")


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=97)


def op12_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.near_sets(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(
        table(spark, sf_dir, "conversations"), base=F.expr("conv - conv % 100"),
        head=F.crc32(F.col("conv").cast("string").cast("binary")) % 6, most_head=5)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_nearest, op2_token_counts, op3_shards, op4_toxicity, op5_byte_bpe, op6_token_files, op7_substrings, op8_lsh_forest,
    op9_mixing, op10_quality, op11_spelling, op12_group_join, op13_prefix_trie)}
ORACLES: dict[str, str] = {}
