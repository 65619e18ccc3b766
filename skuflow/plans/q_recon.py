"""Reconciliation, generators and analytics-run queries (A8, A9, A10, C7, C9, D1,
E8, G1, H3, K2, P4, P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.operators import reconcile, risk
from skuflow.plans.catalog import register
from skuflow.plans.oracle_views import SEED
from skuflow.sources import synthetic, views

RESULT_COLS = ("record_index, supplier_code, product_sku, warehouse_code, reported_quantity, hub_quantity, "
               "difference_quantity, matches")


def _recon(spark, sf, strategy="aggregate"):
    supplier, hub = views.recon_sides(spark, sf)
    return reconcile.reconcile(supplier, hub, strategy)


@register("reconcile_inventory", f"SELECT {RESULT_COLS} FROM v_recon", ["v_recon"])
def q_reconcile_inventory(spark, sf):
    """Validated 1:1 join of supplier-reported vs hub quantities."""
    return _recon(spark, sf)


@register("reconcile_difference",
          "SELECT record_index, difference_quantity, matches FROM v_recon", ["v_recon"])
def q_reconcile_difference(spark, sf):
    """difference = reported - hub; matches = difference == 0."""
    return _recon(spark, sf).select("record_index", "difference_quantity", "matches")


@register("sort_record_index", f"SELECT {RESULT_COLS} FROM v_recon ORDER BY record_index", ["v_recon"])
def q_sort_record_index(spark, sf):
    """G1: the reconciliation result in record_index order."""
    return reconcile.sort_by_record_index(_recon(spark, sf))


_SUMMARY_SQL = """
SELECT count(*) FILTER (WHERE matches) AS match_count,
       count(*) FILTER (WHERE NOT matches) AS mismatch_count,
       count(*) AS input_rows,
       round(count(*) FILTER (WHERE NOT matches) / count(*), 9) AS mismatch_rate
FROM {src}
"""


def _round_summary(df):
    return df.withColumn("mismatch_rate", F.round("mismatch_rate", 9))


@register("reconciliation_summary", _SUMMARY_SQL.format(src="v_recon"), ["v_recon"])
def q_reconciliation_summary(spark, sf):
    """Match / mismatch counts and rate."""
    return _round_summary(reconcile.summary(_recon(spark, sf)))


@register("engine_outputs_equal",
          "SELECT count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS left_only_rows, 0::BIGINT AS right_only_rows, "
          "true AS outputs_equal FROM v_recon", ["v_recon"])
def q_engine_outputs_equal(spark, sf):
    """H3: the single-aggregation plan and the sort-merge join plan of D1
    produce the same multiset."""
    return reconcile.outputs_equal(*reconcile.both_plans(*views.recon_sides(spark, sf)))


@register("reconcile_strategy", f"SELECT {RESULT_COLS} FROM v_recon", ["v_recon"])
def q_reconcile_strategy(spark, sf):
    """K2: caller-chosen join strategy (broadcast only behind a size check)."""
    return _recon(spark, sf, "broadcast")


@register("gen_reconciliation_inputs", """
SELECT record_index, supplier_code, product_sku, warehouse_code, reported_quantity, hub_quantity
FROM g_recon
""", ["g_recon"])
def q_gen_reconciliation_inputs(spark, sf):
    """Deterministic supplier / hub pair, one row per order key."""
    supplier, hub = synthetic.reconciliation_inputs(views.order_index(spark, sf), SEED)
    return supplier.join(hub.drop("product_sku", "warehouse_code"), "record_index")


@register("gen_risk_inputs", """
SELECT record_index, product_sku, warehouse_code, on_hand_quantity, reserved_quantity,
       inbound_quantity, forecast_quantity, actual_demand_quantity
FROM g_risk
""", ["g_risk"])
def q_gen_risk_inputs(spark, sf):
    """Deterministic risk inputs, one row per order key."""
    return synthetic.risk_inputs(views.order_index(spark, sf), SEED)


def bench_inputs(spark, sf):
    """Both sides of P4, to be prepared before a timed join."""
    return synthetic.reconciliation_inputs(views.order_index(spark, sf), SEED)


@register("reconciliation_run", f"""
SELECT 'inventory_reconciliation' AS run_type, 'aggregate' AS engine, {SEED} AS dataset_seed,
       count(*) FILTER (WHERE matches) AS match_count,
       count(*) FILTER (WHERE NOT matches) AS mismatch_count,
       count(*) AS input_rows,
       round(count(*) FILTER (WHERE NOT matches) / count(*), 9) AS mismatch_rate
FROM g_recon
""", ["g_recon"])
def q_reconciliation_run(spark, sf):
    """Generate -> validated join -> difference -> summary (run header)."""
    supplier, hub = synthetic.reconciliation_inputs(views.order_index(spark, sf), SEED)
    results = reconcile.reconcile(supplier, hub, "aggregate")
    return _round_summary(reconcile.summary(results)).select(
        F.lit("inventory_reconciliation").alias("run_type"), F.lit("aggregate").alias("engine"),
        F.lit(SEED).alias("dataset_seed"), "*")


_QTY_COLS = ["on_hand_quantity", "reserved_quantity", "inbound_quantity", "forecast_quantity",
             "actual_demand_quantity", "available_quantity", "projected_ending_quantity",
             "projected_shortage_quantity"]


@register("stockout_risk_run", "SELECT record_index, product_sku, warehouse_code, " + ", ".join(
    f"CAST({c} AS DECIMAL(18,3)) AS {c}" for c in _QTY_COLS
) + ", CAST(shortage_ratio AS DECIMAL(18,6)) AS shortage_ratio, severity FROM g_curated", ["g_curated"])
def q_stockout_risk_run(spark, sf):
    """P5: generate -> score with exact thresholds -> quantised detail rows.

    The generated inputs feed the three quantile passes and the banding, so
    they are materialised once (reliable checkpoint) instead of re-hashed."""
    from skuflow.session import materialize

    inputs = materialize(synthetic.risk_inputs(views.order_index(spark, sf), SEED))
    curated, _ = risk.score(inputs, "exact")
    return curated.select(
        "record_index", "product_sku", "warehouse_code",
        *[F.col(c).cast(S.QTY).alias(c) for c in _QTY_COLS],
        F.col("shortage_ratio").cast(S.RATIO).alias("shortage_ratio"), "severity",
    )


@register("quantize_half_up", """
SELECT event_date, supplier_code, product_sku, warehouse_code,
       CAST(projected_shortage_quantity AS DECIMAL(18,3)) AS projected_shortage_quantity,
       CAST(shortage_ratio AS DECIMAL(18,6)) AS shortage_ratio,
       CAST(absolute_forecast_error / 7 AS DECIMAL(18,3)) AS error_per_day
FROM v_proj
""", ["v_proj"])
def q_quantize_half_up(spark, sf):
    """Half-up quantisation to 3 (quantities) and 6 (ratios) places."""
    from skuflow.functions.scalars import quantize

    p = risk.project_risk(views.v_inv(spark, sf))
    return p.select(
        *S.KEY_COLUMNS,
        quantize("projected_shortage_quantity", 3).alias("projected_shortage_quantity"),
        quantize("shortage_ratio", 6).alias("shortage_ratio"),
        quantize(F.col("absolute_forecast_error") / 7, 3).alias("error_per_day"),
    )


@register("gen_history_partitions", f"""
WITH days AS (SELECT CAST(d AS DATE) AS event_date
              FROM generate_series(DATE '2026-07-27', DATE '2026-07-29', INTERVAL 1 DAY) t(d)),
g AS (
  SELECT event_date, o_orderkey AS i, strftime(event_date, '%Y%m%d') AS s FROM days CROSS JOIN orders),
u AS (
  SELECT event_date, i,
    CAST(('0x' || substr(md5(concat(s, '-', i, '-on_hand')), 1, 8)) AS BIGINT) / 4294967296.0 AS u_on,
    CAST(('0x' || substr(md5(concat(s, '-', i, '-reserved')), 1, 8)) AS BIGINT) / 4294967296.0 AS u_res,
    CAST(('0x' || substr(md5(concat(s, '-', i, '-inbound')), 1, 8)) AS BIGINT) / 4294967296.0 AS u_in,
    CAST(('0x' || substr(md5(concat(s, '-', i, '-factor')), 1, 8)) AS BIGINT) / 4294967296.0 AS u_f,
    ((CAST(('0x' || substr(md5(concat(s, '-', i, '-noise1')), 1, 8)) AS BIGINT) / 4294967296.0
     + CAST(('0x' || substr(md5(concat(s, '-', i, '-noise2')), 1, 8)) AS BIGINT) / 4294967296.0
     + CAST(('0x' || substr(md5(concat(s, '-', i, '-noise3')), 1, 8)) AS BIGINT) / 4294967296.0
     + CAST(('0x' || substr(md5(concat(s, '-', i, '-noise4')), 1, 8)) AS BIGINT) / 4294967296.0)
     - 2.0) * {repr(3.0 ** 0.5)} AS z
  FROM g),
a AS (SELECT *, CAST(floor(20 + u_on * 880) AS DOUBLE) AS on_hand_quantity,
             CAST(floor(u_in * 250) AS DOUBLE) AS inbound_quantity FROM u),
b AS (SELECT *, CAST(floor(on_hand_quantity * u_res * 0.4) AS DOUBLE) AS reserved_quantity FROM a),
c AS (SELECT *, greatest(0.0, round_even((on_hand_quantity - reserved_quantity + inbound_quantity)
                                         * (0.7 + u_f * 0.65), 0)) AS forecast_quantity FROM b)
SELECT event_date, concat('SUP-', i % 3 + 1) AS supplier_code, printf('SKU-%06d', i) AS product_sku,
       printf('WH-%02d', i % 20 + 1) AS warehouse_code, on_hand_quantity, reserved_quantity,
       inbound_quantity, forecast_quantity,
       greatest(0.0, round_even(forecast_quantity * (1.0 + 0.15 * z), 0)) AS actual_demand_quantity
FROM c
""")
def q_gen_history_partitions(spark, sf):
    """A10: three days of seeded history, one row per order key per day."""
    return synthetic.history_partitions(views.order_index(spark, sf), "2026-07-27", "2026-07-29")
