"""Data-quality gate (C8, E1, E2) for history partitions.

The reference scans the input three times (count, invalid count, duplicate
count). Here one grouped aggregate over the key columns carries both the row
count and the invalid count per key; a global aggregate over that (much
smaller, map-side combined) result yields the whole report in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions import scalars as X
from skuflow.functions.frames import attach_scalars


def invalid_rows(df: DataFrame) -> DataFrame:
    """Rows failing the key / quantity rules."""
    return df.where(X.invalid_row())


def duplicate_keys(df: DataFrame, keys: list[str] = S.KEY_COLUMNS) -> DataFrame:
    """Key groups (NULL keys group together) seen more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def quality_report(df: DataFrame, keys: list[str] = S.KEY_COLUMNS,
                   group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """input_rows, invalid_rows, duplicate_keys, passed in one pass.

    ``group_cols`` (a subset of ``keys``, e.g. ``event_date``) gives one report
    per partition for backfills.
    """
    return key_counts(df, keys=keys).groupBy(*group_cols).agg(*report_columns()).withColumn("passed", passed())


def key_counts(df: DataFrame, *more: Column, keys: list[str] = S.KEY_COLUMNS) -> DataFrame:
    """Rows and invalid rows per key, with further aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(X.invalid_row()).alias("_invalid"), *more)


def report_columns() -> list[Column]:
    """The report's aggregates over ``key_counts``."""
    return [
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("input_rows"),
        F.coalesce(F.sum("_invalid"), F.lit(0)).cast("bigint").alias("invalid_rows"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_keys"),
    ]


def passed() -> Column:
    return (F.col("invalid_rows") == 0) & (F.col("duplicate_keys") == 0)


def _guard(ok: Column, invalid: Column, duplicate: Column) -> Column:
    """True, or the end of the job."""
    return F.when(F.coalesce(ok, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("Data-quality gates failed: "), invalid.cast("string"), F.lit(" invalid rows and "),
        duplicate.cast("string"), F.lit(" duplicate keys."))))


def enforce_passed(report: DataFrame) -> DataFrame:
    """``report``, one row, if it passed; else the job fails in-plan."""
    return report.where(_guard(F.col("passed"), F.col("invalid_rows"), F.col("duplicate_keys")))


def enforce_gate(df: DataFrame, report: DataFrame) -> DataFrame:
    """Fail the job in-plan (no driver round trip) when the gate did not pass."""
    gate = report.agg(
        F.sum("invalid_rows").alias("_inv"), F.sum("duplicate_keys").alias("_dup"),
        F.bool_and("passed").alias("_ok"),
    )
    checked = attach_scalars(df, gate)
    guard = _guard(F.col("_ok"), F.col("_inv"), F.col("_dup"))
    return checked.where(guard).drop("_inv", "_dup", "_ok")
