"""Session construction and cluster-shared paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC instants, ANSI on (Spark 4 default), AQE for
# runtime coalescing / skew-join splitting, partition values kept as strings
# (``warehouse_code=01`` must not come back as an int).
BASE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Validation reads many fields of one parsed document; the JSON/CSV
    # field-pruning rewrite would re-parse the document once per field.
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
    "spark.sql.optimizer.enableCsvExpressionOptimization": "false",
    "spark.ui.enabled": "false",
}

# SQL settings re-applied to any session the plans run in (driver sessions included).
RUNTIME_KEYS = [
    "spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy",
    "spark.sql.sources.partitionColumnTypeInference.enabled",
    "spark.sql.optimizer.enableJsonExpressionOptimization",
    "spark.sql.optimizer.enableCsvExpressionOptimization",
]


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "skuflow",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key in RUNTIME_KEYS:
        spark.conf.set(key, BASE_CONF[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local master without one gets a fresh scratch folder; a cluster must
    name a folder that driver and executors share.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    local = tempfile.mkdtemp(prefix="skuflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint directory for a materialised table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df, name: str):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: columnar and pruned by its readers, for a table that several passes
    read; survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Cut lineage once: a reliable checkpoint in the shared checkpoint folder.

    Used at the plan layer where a derived input (generated rows, parsed
    partner records) feeds several passes; survives executor loss, unlike
    ``localCheckpoint``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
