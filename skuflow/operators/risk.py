"""Stockout-risk scoring: projections, thresholds, severity bands, metrics.

C1-C5, E3-E7, E15. All per-row work is one projection; thresholds are an
in-plan aggregate joined back (a one-row broadcast for a single run), so there
is no driver round trip between the quantile and the banding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions import scalars as X
from skuflow.functions.frames import attach_scalars
from skuflow.operators import quality
from skuflow.operators.quantiles import approx_quantiles, exact_quantiles, resolve, sketch_columns

THRESHOLD_NAMES = ["low_to_medium", "medium_to_high"]
THRESHOLD_PROBS = [0.5, 0.8]


def project_risk(df: DataFrame) -> DataFrame:
    """Availability, projected ending/shortage, ratio, forecast error."""
    return (
        df.withColumn("available_quantity", X.available_quantity("on_hand_quantity", "reserved_quantity"))
        .withColumn("projected_ending_quantity",
                    X.projected_ending("available_quantity", "inbound_quantity", "forecast_quantity"))
        .withColumn("projected_shortage_quantity", X.projected_shortage("projected_ending_quantity"))
        .withColumn("shortage_ratio", X.shortage_ratio("projected_shortage_quantity", "forecast_quantity"))
        .withColumn("forecast_error", X.forecast_error("forecast_quantity", "actual_demand_quantity"))
        .withColumn("absolute_forecast_error", F.abs("forecast_error"))
    )


def risk_thresholds(projected: DataFrame, method: str = "exact",
                    group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """E4 (exact, interpolated) or E5 (approximate element) p50/p80 of positive ratios.

    Groups (or a run) without a positive ratio get thresholds (0, 0).
    """
    positive = projected.where(F.col("shortage_ratio") > 0)
    if method == "exact":
        q = exact_quantiles(positive, "shortage_ratio", THRESHOLD_PROBS, THRESHOLD_NAMES, group_cols)
    elif method == "approx":
        q = approx_quantiles(positive, "shortage_ratio", THRESHOLD_PROBS, THRESHOLD_NAMES, group_cols, 1000)
        if not group_cols:
            # A global aggregate over no rows still yields one (NULL) row.
            q = q.select(*[F.col(n) for n in THRESHOLD_NAMES])
    else:
        raise ValueError(f"unknown threshold method {method!r}")
    return q.select(*group_cols, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in THRESHOLD_NAMES])


def gated_thresholds(projected: DataFrame, group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The quality gate (E1) and exact thresholds (E4) from two reads of ``projected``: report columns and
    ``THRESHOLD_NAMES``, one row (per group).

    The first read counts rows and invalid rows per key and, over the keys, sketches the ratios: in a
    history that passes, a key is a row. The second resolves the sketch."""
    g = list(group_cols)
    ratio = F.when(F.col("shortage_ratio") > 0, F.col("shortage_ratio"))
    per_key = quality.key_counts(projected, F.max(ratio).alias("_ratio"))
    stats = per_key.groupBy(*g).agg(*quality.report_columns(), *sketch_columns(F.col("_ratio"), THRESHOLD_PROBS))
    stats = stats.withColumn("passed", quality.passed())
    base = projected.select(*g, ratio.alias("_x")).where(F.col("_x").isNotNull())
    bounds = resolve(base, stats.where("passed").select(*g, "_n", "_a"), THRESHOLD_PROBS, THRESHOLD_NAMES, g)
    report = stats.drop("_a")
    both = report.join(bounds, g, "left") if g else attach_scalars(report, bounds)
    # With _n the report's plan counts ratios as the sketch's does, and shares its exchange.
    return both.select(*[c for c in report.columns if c != "_n"],
                       *[F.when(F.col("_n") > 0, F.col(n)).otherwise(0.0).alias(n) for n in THRESHOLD_NAMES])


def assign_severity(projected: DataFrame, thresholds: DataFrame,
                    group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Band each row against its run's thresholds."""
    g = list(group_cols)
    if g:
        # One threshold row per group: small and bounded by the number of runs.
        joined = projected.join(thresholds, g, "left").fillna(0.0, subset=THRESHOLD_NAMES)
    else:
        joined = attach_scalars(projected, thresholds)
    return banded(joined)


def banded(rows: DataFrame) -> DataFrame:
    """``severity`` of rows that carry their run's thresholds."""
    return rows.withColumn("severity", X.severity_band("shortage_ratio", *THRESHOLD_NAMES)).drop(*THRESHOLD_NAMES)


def score(df: DataFrame, method: str = "exact",
          group_cols: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    projected = project_risk(df)
    thresholds = risk_thresholds(projected, method, group_cols)
    return assign_severity(projected, thresholds, group_cols), thresholds


def severity_summary(curated: DataFrame) -> DataFrame:
    """By (event_date, severity): rows, summed shortage, mean absolute error."""
    return (
        curated.groupBy("event_date", "severity")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("projected_shortage_quantity").alias("projected_shortage_quantity"),
            F.avg("absolute_forecast_error").alias("mean_absolute_error"),
        )
    )


def forecast_metrics(df: DataFrame, forecast: str = "forecast_quantity",
                     actual: str = "actual_demand_quantity",
                     group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, bias, WAPE (0 when sum |actual| is 0). Metrics of no rows
    at all do not exist: the plan fails."""
    err = F.col(forecast) - F.col(actual)
    abs_actual = F.sum(F.abs(F.col(actual)))
    some = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("Forecast metrics need at least one row."))).otherwise(
        F.avg(F.abs(err)))
    return df.groupBy(*group_cols).agg(
        some.alias("mean_absolute_error"),
        F.sqrt(F.avg(err * err)).alias("root_mean_squared_error"),
        F.avg(err).alias("bias"),
        F.when(abs_actual > 0, F.sum(F.abs(err)) / abs_actual).otherwise(F.lit(0.0))
        .alias("weighted_absolute_percentage_error"),
        F.count(F.lit(1)).alias("row_count"),
    )


def severity_counts(curated: DataFrame, group_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Count per severity with all four levels present (zeros kept)."""
    counts = curated.groupBy(*group_cols).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in S.RISK_SEVERITY]
    )
    stacked = ", ".join(f"'{s}', `{s}`" for s in S.RISK_SEVERITY)
    return counts.select(*group_cols, F.expr(f"stack({len(S.RISK_SEVERITY)}, {stacked}) as (severity, row_count)"))


def run_summary(curated: DataFrame, thresholds: DataFrame, method_label: str) -> DataFrame:
    """One composite run header (severity counts + thresholds + metrics)."""
    counts = curated.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in S.RISK_SEVERITY])
    metrics = forecast_metrics(curated).drop("row_count")
    header = attach_scalars(attach_scalars(counts, thresholds), metrics).withColumn("method", F.lit(method_label))
    return header.withColumn(
        "summary_json",
        F.to_json(F.struct(
            F.struct(*[F.col(f"{s}_count").alias(s) for s in S.RISK_SEVERITY]).alias("severity_counts"),
            F.struct("low_to_medium", "medium_to_high", "method").alias("thresholds"),
            F.struct("mean_absolute_error", "root_mean_squared_error", "bias",
                     "weighted_absolute_percentage_error").alias("forecast_metrics"),
        )),
    )
