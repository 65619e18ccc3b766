"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.session import checkpoint_dir
from skuflow.sinks.writers import remove_path

BATCH_BYTES = 8 << 20
#: Folders that ``staged`` made in this process, oldest first.
STAGED: list[str] = []
BATCH_RECORDS = 4000


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks get, by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the cluster's shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed; a lost
    executor costs a re-read. The folder is new for each call.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Remove the folders that ``staged`` made from the ``since``-th on, but for ``keep``: for use when what was
    computed from them has been written."""
    for path in STAGED[since:]:
        if path != keep:
            remove_path(spark, path)
            STAGED.remove(path)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_slices(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """``(start, texts[start:end])`` with about ``limit`` characters each (one long text may exceed it)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null becomes the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
