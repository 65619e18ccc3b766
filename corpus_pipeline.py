"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet to the cluster's shared folder, reads it again as
the next stage's documents, and then removes what the stage before had written.
All but the last stage return the columns of ``documents``. Where a stage shortens
texts, ``n_chars`` follows.

Defined cases: null and empty texts have no features, shingles or repeats: the
classifier scores them like any text, those that stay are one group of equal
texts in the second stage, pass the third unchanged, are of size 0 in the mix
(rate 0 where a source holds nothing else) and have the begin and end ids alone; very
long texts are read whole; repeated rows are near duplicates of each other, of
which one stays; ties go to the least id, rows without an id last; further columns
are kept, whatever their names; an empty table passes all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import bagminhash, mixing, piece_codec, pu_quality, unit_dedup
from skuflow.llm.common import STAGED, documents, remove_staged, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from these documents and ``labels``, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.keep_good(docs, pu_quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates."""
    return bagminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines and passages that an earlier one holds."""
    short = unit_dedup.without_repeats(docs, whole_lines=True)
    if "n_chars" not in docs.columns:
        return short
    return short.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document taken (repeats are rows of their own)."""
    return piece_codec.digests(piece_codec.round_trip(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Learning, signatures and encoding have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = documents(spark, sf_dir), len(STAGED)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # What the stage read and staged on its way is not needed any more.
        remove_staged(spark, first, STAGED[-1])
    return docs
