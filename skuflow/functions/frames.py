"""Frame-level helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate: thresholds,
    gate totals, a cursor) to every row of ``df``.

    The right side has exactly one row by construction (a global aggregate or a
    unique key), so this is a broadcast of one row and linear in ``df`` - not a
    pairwise product.
    """
    return df.crossJoin(F.broadcast(one_row))


def exactly_one(frame: DataFrame, what: str) -> DataFrame:
    """``frame`` if it has one row; otherwise the plan fails. For a row that is looked up rather than
    aggregated, before ``attach_scalars``: two rows would double the other side, none would empty it."""
    found = frame.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*frame.columns)).alias("_row"))
    error = F.raise_error(F.concat(F.lit(f"{what}: one row expected, not "), F.col("_n").cast("string")))
    return found.select(F.when(F.col("_n") == 1, F.col("_row")).otherwise(error).alias("_row")).select("_row.*")
