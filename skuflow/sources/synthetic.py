"""Deterministic synthetic inputs (A8-A10) derived from a driving table.

The reference draws from NumPy's PCG64 stream on one machine. Here every value
is a pure function of (seed, row index, field) through md5, so any executor
computes any row without coordination and the same numbers come out in DuckDB.
Row indices come from a dense key of a driver table (``orders.o_orderkey``)
so the work grows with the data; ``spark.range(n)`` serves the same role when
called with an explicit row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions.scalars import md5_uint

DEFAULT_SEED = 20260729
_TWO32 = 4294967296.0
SQRT3 = math.sqrt(3.0)


def uint(seed: int, idx: Column, field: str) -> Column:
    """Uniform integer in [0, 2^32) for (seed, idx, field)."""
    return md5_uint(F.concat(F.lit(f"{seed}-"), idx.cast("string"), F.lit(f"-{field}")))


def unit(seed: int, idx: Column, field: str) -> Column:
    """Uniform double in [0, 1)."""
    return uint(seed, idx, field) / F.lit(_TWO32)


def std_normal(seed: int, idx: Column, field: str) -> Column:
    """Approximately standard normal: Irwin-Hall sum of four uniforms, rescaled.

    Exact IEEE arithmetic on both engines (no transcendental functions).
    """
    s = unit(seed, idx, f"{field}1") + unit(seed, idx, f"{field}2") + \
        unit(seed, idx, f"{field}3") + unit(seed, idx, f"{field}4")
    return (s - F.lit(2.0)) * F.lit(SQRT3)


def reconciliation_inputs(index: DataFrame, seed: int = DEFAULT_SEED, index_col: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(supplier rows, hub rows) keyed by ``record_index``."""
    i = F.col(index_col).cast("bigint")
    deltas = F.array(*[F.lit(d) for d in S.RECONCILIATION_DELTAS])
    base = index.select(
        i.alias("record_index"),
        (uint(seed, i, "hub") % 500).alias("hub_quantity"),
        F.element_at(deltas, (uint(seed, i, "delta") % 10 + 1).cast("int")).cast("bigint").alias("_delta"),
        F.format_string("SYN-SKU-%07d", i).alias("product_sku"),
        F.format_string("SYN-WH-%02d", i % 25).alias("warehouse_code"),
        F.concat(F.lit("SYN-SUPPLIER-"), (i % 4).cast("string")).alias("supplier_code"),
    )
    supplier = base.select(
        "record_index", "supplier_code", "product_sku", "warehouse_code",
        F.greatest(F.col("hub_quantity") + F.col("_delta"), F.lit(0).cast("bigint")).alias("reported_quantity"),
    )
    hub = base.select("record_index", "product_sku", "warehouse_code", "hub_quantity")
    return supplier, hub


def risk_inputs(index: DataFrame, seed: int = DEFAULT_SEED, index_col: str = "idx") -> DataFrame:
    """on_hand 20..499; reserved = floor(on_hand * U[0,.45)); inbound 0..179;
    forecast = max(1, rint((available + inbound) * U[.65,1.45)));
    actual = max(0, rint(forecast * N(1, .18)))."""
    i = F.col(index_col).cast("bigint")
    on_hand = (F.lit(20) + uint(seed, i, "on_hand") % 480).cast("double")
    reserved = F.floor(on_hand * (unit(seed, i, "reserved") * F.lit(0.45))).cast("double")
    inbound = (uint(seed, i, "inbound") % 180).cast("double")
    df = index.select(
        i.alias("record_index"),
        F.format_string("SYN-RISK-SKU-%07d", i).alias("product_sku"),
        F.format_string("SYN-WH-%02d", i % 25).alias("warehouse_code"),
        on_hand.alias("on_hand_quantity"),
        reserved.alias("reserved_quantity"),
        inbound.alias("inbound_quantity"),
        (F.lit(0.65) + unit(seed, i, "factor") * F.lit(0.8)).alias("_factor"),
        std_normal(seed, i, "noise").alias("_z"),
    )
    df = df.withColumn("forecast_quantity", F.greatest(F.lit(1.0), F.rint(
        (F.col("on_hand_quantity") - F.col("reserved_quantity") + F.col("inbound_quantity")) * F.col("_factor"))))
    df = df.withColumn("actual_demand_quantity", F.greatest(F.lit(0.0), F.rint(
        F.col("forecast_quantity") * (F.lit(1.0) + F.lit(0.18) * F.col("_z")))))
    return df.drop("_factor", "_z")


def history_partitions(index: DataFrame, start: str, end: str, rows_per_day_col: str = "idx",
                       inject_invalid: bool = False) -> DataFrame:
    """A10: per-day history rows for every date in [start, end].

    on_hand 20..899, reserved <= 40%, inbound 0..249, forecast factor U[.7,1.35),
    actual noise N(1,.15); 3 suppliers, 20 warehouses; seed = yyyymmdd.
    ``index`` supplies the per-day row indices (one row per index value).
    """
    if end < start:
        raise ValueError("end date must not precede start date")
    day_seq = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    days = index.sparkSession.range(1).select(F.explode(day_seq).alias("event_date"))
    # Each row index expands to its per-day rows (output = days x rows, by definition).
    grid = index.select(F.col(rows_per_day_col).cast("bigint").alias("_i"), F.explode(day_seq).alias("event_date"))
    seed_col = F.date_format("event_date", "yyyyMMdd")
    i = F.col("_i")

    def u(field):
        return md5_uint(F.concat(seed_col, F.lit("-"), i.cast("string"), F.lit(f"-{field}"))) / F.lit(_TWO32)

    def z(field):
        return (u(f"{field}1") + u(f"{field}2") + u(f"{field}3") + u(f"{field}4") - F.lit(2.0)) * F.lit(SQRT3)

    on_hand = F.floor(F.lit(20) + u("on_hand") * 880).cast("double")
    reserved = F.floor(on_hand * u("reserved") * F.lit(0.4)).cast("double")
    inbound = F.floor(u("inbound") * 250).cast("double")
    forecast = F.greatest(F.lit(0.0), F.rint((on_hand - reserved + inbound) * (F.lit(0.7) + u("factor") * F.lit(0.65))))
    actual = F.greatest(F.lit(0.0), F.rint(forecast * (F.lit(1.0) + F.lit(0.15) * z("noise"))))
    rows = grid.select(
        "event_date",
        F.concat(F.lit("SUP-"), (i % 3 + 1).cast("string")).alias("supplier_code"),
        F.format_string("SKU-%06d", i).alias("product_sku"),
        F.format_string("WH-%02d", i % 20 + 1).alias("warehouse_code"),
        on_hand.alias("on_hand_quantity"), reserved.alias("reserved_quantity"),
        inbound.alias("inbound_quantity"), forecast.alias("forecast_quantity"),
        actual.alias("actual_demand_quantity"),
    )
    if inject_invalid:
        broken = days.select(
            "event_date", F.lit("SUP-1").alias("supplier_code"), F.lit("").alias("product_sku"),
            F.lit("WH-01").alias("warehouse_code"), F.lit(-1.0).alias("on_hand_quantity"),
            F.lit(0.0).alias("reserved_quantity"), F.lit(0.0).alias("inbound_quantity"),
            F.lit(1.0).alias("forecast_quantity"), F.lit(1.0).alias("actual_demand_quantity"),
        )
        rows = rows.unionByName(broken)
    return rows
