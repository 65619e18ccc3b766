"""Risk-scoring and quality-gate queries over the inventory history views."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.operators import quality, risk
from skuflow.plans.catalog import register
from skuflow.sources import views

KEYS = ", ".join(S.KEY_COLUMNS)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@register("available_quantity", """
SELECT event_date, supplier_code, product_sku, warehouse_code,
       CASE WHEN on_hand_quantity IS NOT NULL AND reserved_quantity IS NOT NULL
            THEN greatest(on_hand_quantity - reserved_quantity, 0.0) END AS available_quantity,
       coalesce(on_hand_quantity >= 0 AND reserved_quantity >= 0, false) AS quantities_valid
FROM v_inv_raw
""", ["v_inv_raw"])
def q_available_quantity(spark, sf):
    from skuflow.functions import scalars as X
    h = views.v_inv_raw(spark, sf)
    return h.select(
        *S.KEY_COLUMNS,
        X.available_quantity("on_hand_quantity", "reserved_quantity").alias("available_quantity"),
        X.available_quantity_valid("on_hand_quantity", "reserved_quantity").alias("quantities_valid"),
    )


@register("stockout_projection", f"""
SELECT {KEYS}, available_quantity, projected_ending_quantity, projected_shortage_quantity
FROM v_proj
""", ["v_proj"])
def q_stockout_projection(spark, sf):
    p = risk.project_risk(views.v_inv(spark, sf))
    return p.select(*S.KEY_COLUMNS, "available_quantity", "projected_ending_quantity",
                    "projected_shortage_quantity")


@register("shortage_ratio", f"SELECT {KEYS}, forecast_quantity, shortage_ratio FROM v_proj", ["v_proj"])
def q_shortage_ratio(spark, sf):
    p = risk.project_risk(views.v_inv(spark, sf))
    return p.select(*S.KEY_COLUMNS, "forecast_quantity", "shortage_ratio")


@register("forecast_error", f"SELECT {KEYS}, forecast_error, absolute_forecast_error FROM v_proj", ["v_proj"])
def q_forecast_error(spark, sf):
    p = risk.project_risk(views.v_inv(spark, sf))
    return p.select(*S.KEY_COLUMNS, "forecast_error", "absolute_forecast_error")


@register("severity_band", f"SELECT {KEYS}, shortage_ratio, severity FROM v_curated", ["v_curated"])
def q_severity_band(spark, sf):
    curated, _ = risk.score(views.v_inv(spark, sf), "exact")
    return curated.select(*S.KEY_COLUMNS, "shortage_ratio", "severity")


@register("invalid_rows", "SELECT * FROM v_inv_raw WHERE " + " OR ".join(
    [f"{c} IS NULL" for c in S.KEY_COLUMNS]
    + [f"trim({c}) = ''" for c in S.KEY_COLUMNS[1:]]
    + [f"{c} IS NULL OR {c} < 0" for c in S.QUANTITY_COLUMNS]
), ["v_inv_raw"])
def q_invalid_rows(spark, sf):
    return quality.invalid_rows(views.v_inv_raw(spark, sf))


_INVALID_SQL = " OR ".join(
    [f"{c} IS NULL" for c in S.KEY_COLUMNS]
    + [f"trim({c}) = ''" for c in S.KEY_COLUMNS[1:]]
    + [f"{c} IS NULL OR {c} < 0" for c in S.QUANTITY_COLUMNS]
)


@register("quality_report", f"""
WITH k AS (
  SELECT {KEYS}, count(*) AS n, count(*) FILTER (WHERE {_INVALID_SQL}) AS inv
  FROM v_inv_raw GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(sum(inv) AS BIGINT) AS invalid_rows,
       count(*) FILTER (WHERE n > 1) AS duplicate_keys,
       (sum(inv) = 0 AND count(*) FILTER (WHERE n > 1) = 0) AS passed
FROM k
""", ["v_inv_raw"])
def q_quality_report(spark, sf):
    return quality.quality_report(views.v_inv_raw(spark, sf))


@register("duplicate_keys", f"SELECT {KEYS}, count(*) AS count FROM v_inv GROUP BY ALL HAVING count(*) > 1",
          ["v_inv"])
def q_duplicate_keys(spark, sf):
    return quality.duplicate_keys(views.v_inv(spark, sf))


@register("severity_summary", """
SELECT event_date, severity, count(*) AS row_count,
       sum(projected_shortage_quantity) AS projected_shortage_quantity,
       round(avg(absolute_forecast_error), 6) AS mean_absolute_error
FROM v_curated GROUP BY event_date, severity
""", ["v_curated"])
def q_severity_summary(spark, sf):
    curated, _ = risk.score(views.v_inv(spark, sf), "exact")
    s = risk.severity_summary(curated)
    return s.withColumn("mean_absolute_error", r6("mean_absolute_error"))


@register("shortage_quantiles_exact", """
SELECT round(low_to_medium, 10) AS low_to_medium, round(medium_to_high, 10) AS medium_to_high FROM v_thr
""", ["v_thr"])
def q_shortage_quantiles_exact(spark, sf):
    t = risk.risk_thresholds(risk.project_risk(views.v_inv(spark, sf)), "exact")
    return t.select(*[F.round(c, 10).alias(c) for c in risk.THRESHOLD_NAMES])


@register("shortage_quantiles_approx")
def q_shortage_quantiles_approx(spark, sf):
    """E5: Greenwald-Khanna p50/p80 (rel. error 0.001); rows-only check."""
    return risk.risk_thresholds(risk.project_risk(views.v_inv(spark, sf)), "approx")


@register("forecast_metrics", """
SELECT round(avg(abs(forecast_quantity - actual_demand_quantity)), 6) AS mean_absolute_error,
       round(sqrt(avg((forecast_quantity - actual_demand_quantity)
                      * (forecast_quantity - actual_demand_quantity))), 6) AS root_mean_squared_error,
       round(avg(forecast_quantity - actual_demand_quantity), 6) AS bias,
       round(CASE WHEN sum(abs(actual_demand_quantity)) > 0
                  THEN sum(abs(forecast_quantity - actual_demand_quantity)) / sum(abs(actual_demand_quantity))
                  ELSE 0.0 END, 6) AS weighted_absolute_percentage_error,
       count(*) AS row_count
FROM v_inv
""", ["v_inv"])
def q_forecast_metrics(spark, sf):
    m = risk.forecast_metrics(views.v_inv(spark, sf))
    return m.select(*[r6(c).alias(c) for c in m.columns if c != "row_count"], "row_count")


@register("severity_counts", """
SELECT s.severity, count(c.severity) AS row_count
FROM (VALUES ('none'), ('low'), ('medium'), ('high')) s(severity)
LEFT JOIN v_curated c ON c.severity = s.severity
GROUP BY s.severity
""", ["v_curated"])
def q_severity_counts(spark, sf):
    curated, _ = risk.score(views.v_inv(spark, sf), "exact")
    return risk.severity_counts(curated)


@register("run_row_summary", """
SELECT count(*) FILTER (WHERE severity = 'none') AS none_count,
       count(*) FILTER (WHERE severity = 'low') AS low_count,
       count(*) FILTER (WHERE severity = 'medium') AS medium_count,
       count(*) FILTER (WHERE severity = 'high') AS high_count,
       round(any_value(t.low_to_medium), 10) AS low_to_medium,
       round(any_value(t.medium_to_high), 10) AS medium_to_high,
       'positive shortage-ratio p50 and p80' AS method,
       round(avg(absolute_forecast_error), 6) AS mean_absolute_error,
       round(sqrt(avg(forecast_error * forecast_error)), 6) AS root_mean_squared_error,
       round(avg(forecast_error), 6) AS bias,
       round(sum(absolute_forecast_error) / sum(abs(actual_demand_quantity)), 6)
         AS weighted_absolute_percentage_error
FROM v_curated CROSS JOIN v_thr t
""", ["v_curated", "v_thr"])
def q_run_row_summary(spark, sf):
    curated, thresholds = risk.score(views.v_inv(spark, sf), "exact")
    h = risk.run_summary(curated, thresholds, S.THRESHOLD_METHOD_EXACT)
    out = []
    for c in h.columns:
        if c in ("low_to_medium", "medium_to_high"):
            out.append(F.round(c, 10).alias(c))
        elif c in ("mean_absolute_error", "root_mean_squared_error", "bias",
                   "weighted_absolute_percentage_error"):
            out.append(r6(c).alias(c))
        elif c != "summary_json":
            out.append(F.col(c))
    return h.select(*out)
