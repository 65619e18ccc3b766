"""File sources: history CSV partitions (A1, A2), manifest documents (A6),
retained payloads with checksum verification (A7).

Paths may be any Hadoop-compatible URI (object store, HDFS, local); reads go
straight through the Hadoop filesystem layer, nothing is downloaded first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow import schemas as S


def scan_history_csv(spark: SparkSession, path: str | list[str], base_path: str | None = None) -> DataFrame:
    """A1: CSV with header and the fixed 9-column schema; bad cells become NULL.

    ``path`` is a date prefix (``.../event_date=YYYY-MM-DD/``) or a root. Files
    that carry ``event_date`` as a data column (the partner layout) are read
    as is; for Spark-partitioned output, where the date lives only in the
    path, pass the root as ``base_path`` so the date comes from the path. The
    schema is declared, never inferred.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(S.HISTORY_SCHEMA)
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.csv(path)


def write_history_csv(history: DataFrame, root: str) -> None:
    """Publish history as CSV partitioned by ``event_date`` (the raw layout)."""
    # Cluster rows by date so each date is written by few tasks (AQE splits a hot date).
    (history.hint("rebalance", "event_date").write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy("event_date").csv(root))


def partition_inventory(spark: SparkSession, root: str) -> DataFrame:
    """A2: objects per date partition (metadata only - ``content`` is never read).

    Raise-when-empty is the caller's check on this (small) result.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "false").load(root))
    return files.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("object_count"),
        F.sum("length").alias("total_bytes"),
    )


def require_objects(inventory: DataFrame, partition_date: str) -> DataFrame:
    """Fail in-plan when a date has no objects (``check_source``)."""
    present = inventory.where(F.col("event_date") == F.lit(partition_date).cast("date"))
    summary = present.agg(F.coalesce(F.sum("object_count"), F.lit(0)).alias("_n"))
    return summary.select(
        F.lit(partition_date).alias("partition_date"),
        F.when(F.col("_n") > 0, F.col("_n")).otherwise(
            F.raise_error(F.lit(f"No raw inventory objects exist for {partition_date}."))).alias("object_count"),
    )


def scan_manifests(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """The catalogue of published runs below ``root``, newest key first.

    Keys are the documents' own paths below ``manifests/``, whether a document
    is one object or a folder that a Spark job wrote; ``latest`` pointers are
    left out. Only the last ``limit`` documents (the size of the report) are
    read; undecodable or non-object ones among them are skipped, wrong-typed
    fields become NULL, status defaults to ``unknown``.
    """
    key = F.regexp_extract("path", r"(manifests/.*?\.json)(?:/part-[^/]*)?$", 1)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/manifests")
              .select("path", key.alias("manifest_key"))
              .where((F.col("manifest_key") != "") & ~F.col("manifest_key").endswith("/latest.json")))
    paths = [r.path for r in listed.orderBy(F.desc("manifest_key")).limit(limit).collect()]
    if paths:
        docs = spark.read.option("wholetext", "true").text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    else:
        docs = spark.createDataFrame([], "value string, path string")
    parsed = docs.select(key.alias("manifest_key"), "value", F.from_json("value", S.MANIFEST_SCHEMA, {"mode": "PERMISSIVE"})
                         .alias("m")).where(F.col("value").rlike(r"^\s*\{") & F.col("m").isNotNull())

    def objects(c: str):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))

    return parsed.select(
        "manifest_key", F.coalesce("m.status", F.lit("unknown")).alias("status"),
        F.col("m.partition_date").alias("partition_date"), F.col("m.run_id").alias("run_id"),
        F.col("m.created_at").alias("created_at"), F.col("m.input_rows").alias("input_rows"),
        objects("m.curated_keys").alias("curated_object_count"), objects("m.summary_keys").alias("summary_object_count"),
        F.col("m.spark_version").alias("spark_version"),
    ).orderBy(F.desc("manifest_key"))


def verified_payloads(spark: SparkSession, jobs: DataFrame, root: str) -> DataFrame:
    """Join retained payload files to their jobs and verify SHA-256.

    ``jobs``: job_id, payload_path, content_sha256. Status: ok /
    missing (permanent) / checksum_mismatch (permanent).
    """
    files = spark.read.format("binaryFile").load(root)
    actual = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_actual"))
    j = jobs.join(actual, F.col("payload_path") == F.col("_path"), "left")
    status = (F.when(F.col("_path").isNull(), F.lit("missing"))
              .when(F.col("_actual") != F.col("content_sha256"), F.lit("checksum_mismatch"))
              .otherwise(F.lit("ok")))
    return j.select("job_id", "payload_path", status.alias("payload_status"))


def payload_contents(spark: SparkSession, verified: DataFrame, root: str) -> DataFrame:
    """Bytes of the payloads that ``verified_payloads`` found in order: a second
    read by path, so that no bytes travel through the check's join."""
    files = spark.read.format("binaryFile").load(root).select(F.col("path").alias("payload_path"), "content")
    return verified.where("payload_status = 'ok'").select("job_id", "payload_path").join(files, "payload_path")
