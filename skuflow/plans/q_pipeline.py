"""Composite pipeline queries: P1 (flagship) and P7 (backfill)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.plans import pipeline
from skuflow.plans.catalog import register
from skuflow.session import store
from skuflow.sources import views

_SUMMARY_SQL = """
SELECT event_date, severity, count(*) AS row_count,
       sum(projected_shortage_quantity) AS projected_shortage_quantity,
       round(avg(absolute_forecast_error), 6) AS mean_absolute_error
FROM {src} GROUP BY event_date, severity
"""


def _round(summary):
    return summary.withColumn("mean_absolute_error", F.round("mean_absolute_error", 6))


@register("inventory_risk_pipeline", _SUMMARY_SQL.format(src="c_curated"), ["c_curated"])
def q_inventory_risk_pipeline(spark, sf):
    """De-duplicated history -> gate (fails in-plan) -> bands -> summary. The
    gate, three quantile passes and the banding read the stored history."""
    return _round(pipeline.gated_summary(store(views.v_inv_clean(spark, sf), "history"), "exact"))


@register("backfill", _SUMMARY_SQL.format(src="d_curated"), ["d_curated"])
def q_backfill(spark, sf):
    """Every partition date as its own run (per-date gate and thresholds)."""
    return _round(pipeline.gated_summary(store(views.v_inv_clean(spark, sf), "history"), "exact", ["event_date"]))
