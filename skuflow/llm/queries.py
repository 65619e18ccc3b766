"""The operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import (
    bagminhash,
    collision_ann,
    fingerprints,
    licences,
    mixing,
    pattern_packing,
    phrase_mining,
    piece_codec,
    prefix_trie,
    pu_quality,
    sharding,
    toxicity,
    unit_dedup,
)
from skuflow.llm.common import documents

QueryFn = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.round_trip(documents(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the class of near duplicates they fall into and whether they stay."""
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines and passages, with the removed spans of the original text."""
    return unit_dedup.remove_repeats(documents(spark, sf_dir), whole_lines=True)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt`` with their own or inherited licence."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    docs = documents(spark, sf_dir)
    path = F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt"))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(documents(spark, sf_dir))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pu_quality.score(docs, pu_quality.fit(docs, _labels(spark, sf_dir)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_documents(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_sentencepiece, op2_toxicity, op3_bagminhash, op4_unit_dedup, op5_licences, op6_mixing, op7_fingerprints,
    op8_quality, op9_sharding, op10_nearest, op11_phrases, op12_packing, op13_prefix_trie)}

ORACLE: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op9_sharding": sharding.ORACLE,
                          "op11_phrases": phrase_mining.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
