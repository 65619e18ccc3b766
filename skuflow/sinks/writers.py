"""Sinks: partitioned Parquet, JSON documents, append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_curated_parquet(curated: DataFrame, path: str, partition_col: str = "warehouse_code") -> None:
    """B1: overwrite curated rows partitioned by warehouse.

    ``REBALANCE`` lets AQE size the write tasks by the partition column and
    split a hot warehouse over several tasks (bounded file count, no skew).
    Static overwrite: warehouses of an earlier attempt do not stay.
    """
    (curated.hint("rebalance", partition_col)
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition_col).parquet(path))


def write_summary_parquet(summary: DataFrame, path: str) -> None:
    """B2: the severity summary (dates x 4 rows) as one file."""
    summary.coalesce(1).write.mode("overwrite").parquet(path)


def write_json_document(spark: SparkSession, doc: dict, path: str, mode: str = "errorifexists") -> None:
    """One JSON document as a one-row dataset (run-id paths are
    immutable via ``errorifexists``; ``latest`` pointers use ``overwrite``)."""
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1) \
        .write.mode(mode).text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads(rows[0][0])


def write_raw_content_addressed(files: DataFrame, root: str) -> DataFrame:
    """Retain untouched payload bytes under
    ``source=<type>/ingest_date=<date>/`` keyed by SHA-256, once per hash.

    ``files`` needs ``content`` (binary), ``source_type`` and ``observed_at``.
    Objects that ``root`` already holds are not stored again. Returns the rows
    with ``object_key`` and ``stored_length``.
    """
    from skuflow.functions import scalars as X

    keyed = (
        files.withColumn("content_sha256", F.sha2("content", 256))
        .withColumn("ingest_date", F.date_format("observed_at", "yyyy-MM-dd"))
        .withColumn("object_key", X.raw_object_key("source_type", "content_sha256", "observed_at"))
        .withColumn("stored_length", F.length("content"))
        .dropDuplicates(["content_sha256", "source_type", "ingest_date"])
    )
    new = keyed.select(F.col("source_type").alias("source"), "ingest_date", "content_sha256", "object_key", "content",
                       "stored_length")
    if path_exists(files.sparkSession, root):
        held = files.sparkSession.read.parquet(root).select(
            "content_sha256", F.col("source").cast("string"), F.col("ingest_date").cast("string"))
        new = new.join(held, ["source", "ingest_date", "content_sha256"], "left_anti")
    (new.select("source", "ingest_date", "content_sha256", "object_key", "content", "stored_length")
     .write.mode("append").partitionBy("source", "ingest_date").parquet(root))
    return keyed


def write_analytics_run(header: DataFrame, details: DataFrame, root: str) -> None:
    """Run header and detail rows keyed by (run_id, record_index). Details
    are dealt by ranges of the key, so a large run is written by many tasks. A
    repeated run replaces its own partition, so nothing of it is stored twice."""
    def replace(df: DataFrame, name: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}"))

    replace(header, "analytics_runs")
    replace(details.repartitionByRange("run_id", "record_index").sortWithinPartitions("run_id", "record_index"), "analytics_details")


def append_operation_events(events: DataFrame, path: str, key: str = "event_id") -> None:
    """Append-only audit events (component, stage, status, details). Events that have
    a ``key`` are stored once, whichever attempt of a stage brings them."""
    if key in events.columns:
        events = events.dropDuplicates([key])
        if path_exists(events.sparkSession, path):
            held = events.sparkSession.read.parquet(path).select(key)
            events = events.join(held, key, "left_anti")
    events.write.mode("append").parquet(path)


def _path(spark: SparkSession, path: str):
    """``(file system, path)`` of any Hadoop-compatible URI."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove an output folder (a no-op if it is not there)."""
    fs, hadoop = _path(spark, path)
    fs.delete(hadoop, True)


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern (one listing, metadata only)."""
    fs, hadoop = _path(spark, pattern)
    return [str(s.getPath().toString()) for s in fs.globStatus(hadoop) or []]


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Put ``source`` in the place of ``target``."""
    fs, at = _path(spark, target)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(_path(spark, source)[1], at):
        raise OSError(f"{source} could not be moved to {target}")


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Relative keys of the files under ``path`` (Hadoop FS listing, metadata only)."""
    fs, root = _path(spark, path)
    if not fs.exists(root):
        return []
    qualified = fs.makeQualified(root).toString().rstrip("/")
    it = fs.listFiles(root, True)
    keys = []
    while it.hasNext():
        p = it.next().getPath().toString()
        rel = p[len(qualified) + 1:] if p.startswith(qualified) else p
        if not rel.split("/")[-1].startswith(("_", ".")):
            keys.append(rel)
    return sorted(keys)
