"""Reporting queries over the hub entity tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skuflow.functions import scalars as X
from skuflow.functions.frames import attach_scalars, exactly_one
from skuflow.operators import imports, lifecycle, partners, reports
from skuflow.plans.catalog import register
from skuflow.plans.q_imports import accepted_snapshots
from skuflow.session import materialize, store
from skuflow.sources import entities as E
from skuflow.sources import views

_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _iso(c):
    return X.utc_iso(c).alias(c)


def _positions(spark, sf):
    return imports.positions(accepted_snapshots(spark, sf))


_LINEAGE_SQL = """
SELECT s.import_job_id, s.source_row, s.source_reference, s.external_sku, p.sku AS canonical_sku,
       s.external_location, w.code AS warehouse_code, s.units_per_source_unit,
       CAST(s.on_hand_quantity / s.units_per_source_unit AS DECIMAL(18,3)) AS source_on_hand,
       s.on_hand_quantity AS canonical_on_hand,
       CAST(s.reserved_quantity / s.units_per_source_unit AS DECIMAL(18,3)) AS source_reserved,
       s.reserved_quantity AS canonical_reserved, s.product_mapping_version, s.warehouse_mapping_version
FROM v_snapshots s JOIN e_products p USING (product_id) JOIN e_warehouses w USING (warehouse_id)
"""


@register("snapshot_lineage", _LINEAGE_SQL, ["v_snapshots", "e_products", "e_warehouses"])
def q_snapshot_lineage(spark, sf):
    """Snapshot joined to canonical product and warehouse, with source units."""
    s = accepted_snapshots(spark, sf)
    j = s.join(E.products(spark, sf).select("product_id", F.col("sku").alias("canonical_sku")), "product_id") \
        .join(E.warehouses(spark, sf).select("warehouse_id", F.col("code").alias("warehouse_code")), "warehouse_id")
    return j.select(
        "import_job_id", "source_row", "source_reference", "external_sku", "canonical_sku", "external_location",
        "warehouse_code", "units_per_source_unit",
        X.reverse_unit("on_hand_quantity", "units_per_source_unit").alias("source_on_hand"),
        F.col("on_hand_quantity").alias("canonical_on_hand"),
        X.reverse_unit("reserved_quantity", "units_per_source_unit").alias("source_reserved"),
        F.col("reserved_quantity").alias("canonical_reserved"),
        "product_mapping_version", "warehouse_mapping_version",
    )


@register("reverse_unit_view", """
SELECT import_job_id, source_row, units_per_source_unit,
       CAST(on_hand_quantity / units_per_source_unit AS DECIMAL(18,3)) AS source_on_hand, on_hand_quantity
FROM v_snapshots
""", ["v_snapshots"])
def q_reverse_unit_view(spark, sf):
    """Source quantity = canonical / factor beside the canonical value."""
    s = accepted_snapshots(spark, sf)
    return s.select("import_job_id", "source_row", "units_per_source_unit",
                    X.reverse_unit("on_hand_quantity", "units_per_source_unit").alias("source_on_hand"),
                    "on_hand_quantity")


def _lines(spark, sf):
    return reports.sequence_numbers(E.order_lines(spark, sf), ["order_id"], ["input_pos"], "line_number")


@register("order_line_numbers", """
SELECT order_id, product_id,
       CAST(row_number() OVER (PARTITION BY order_id ORDER BY pos1, pos2) AS INTEGER) AS line_number
FROM e_order_lines
""", ["e_order_lines"])
def q_order_line_numbers(spark, sf):
    """1-based line numbers by input order."""
    return _lines(spark, sf).select("order_id", "product_id", "line_number")


@register("order_with_lines", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY pos1, pos2) AS line_number
           FROM e_order_lines)
SELECT o.order_id, o.supplier_id, o.status, count(*) AS line_count,
       string_agg(concat(l.line_number, ':', l.product_id, ':', CAST(l.ordered_quantity AS VARCHAR)), ';'
                  ORDER BY l.line_number) AS lines
FROM e_orders o JOIN l USING (order_id) GROUP BY o.order_id, o.supplier_id, o.status
""", ["e_orders", "e_order_lines"])
def q_order_with_lines(spark, sf):
    """Purchase order plus its lines ordered by line number (lines per order
    are bounded, so the per-order array is bounded)."""
    lines = _lines(spark, sf).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.array_sort(F.collect_list(F.struct("line_number", "product_id", "ordered_quantity"))).alias("_l"),
    )
    o = E.purchase_orders(spark, sf).join(lines, "order_id")
    return o.select("order_id", "supplier_id", "status", "line_count", F.array_join(F.transform(
        "_l", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["product_id"],
                                    x["ordered_quantity"].cast("string"))), ";").alias("lines"))


@register("shipment_with_events", f"""
SELECT s.shipment_id, coalesce(c.status, 'planned') AS status,
       CASE WHEN v.shipment_id IS NOT NULL THEN
         CAST(row_number() OVER (PARTITION BY v.shipment_id ORDER BY v.occurred_at, v.arrival_seq) AS INTEGER) END
         AS event_seq, v.external_event_id, v.event_type, {_ISO.format(c='v.occurred_at')} AS occurred_at
FROM v_shipments s LEFT JOIN cc_states c USING (shipment_id)
LEFT JOIN cc_verdicts v ON v.shipment_id = s.shipment_id AND v.verdict = 'accepted'
""", ["v_shipments", "cc_states", "cc_verdicts"])
def q_shipment_with_events(spark, sf):
    """Every shipment with its accepted events ordered by occurred_at (one
    row without an event where there is none)."""
    events, _ = partners.parse_carrier_events(views.carrier_raw(spark, sf))
    ships = views.shipments(spark, sf)
    v = materialize(lifecycle.event_verdicts(events, ships).select(
        "shipment_id", "verdict", "status_after", "arrival_seq", "external_event_id", "event_type", "occurred_at"))
    states = lifecycle.shipment_states(v, ships).select("shipment_id", "status")
    # Events per shipment are not bounded by the data model: number them with
    # the skew-safe scan rather than a window per shipment.
    acc = reports.sequence_numbers(v.where(F.col("verdict") == "accepted"), ["shipment_id"],
                                   ["occurred_at", "arrival_seq"], "event_seq", skew_safe=True)
    return states.join(acc.select("shipment_id", "event_seq", "external_event_id", "event_type", "occurred_at"),
                       "shipment_id", "left").select("shipment_id", "status", "event_seq", "external_event_id", "event_type",
                                             _iso("occurred_at"))


@register("import_detail", """
SELECT j.job_id, j.status, c.section, c.position, c.item
FROM e_jobs j LEFT JOIN (
  SELECT job_id, 'event' AS section, event_seq AS position, concat(component, ':', status) AS item FROM e_op_events
  UNION ALL
  SELECT job_id, 'attempt', attempt_number, concat(status, ':', coalesce(error_type, '')) FROM e_attempts_numbered
  UNION ALL
  SELECT job_id, 'error', NULL, concat(error_code, ':', coalesce(field_name, ''), ':', message) FROM e_import_errors
  UNION ALL
  SELECT job_id, 'snapshot', source_row, concat(product_id, ':', on_hand) FROM e_job_snapshots
) c USING (job_id)
""", ["e_jobs", "e_op_events", "e_attempts_numbered", "e_import_errors", "e_job_snapshots"])
def q_import_detail(spark, sf):
    """Every job with its events, attempts, errors and snapshots, one row per
    child in its section's order (one row without a child where there is none)."""
    att = reports.attempt_outcomes(reports.sequence_numbers(
        E.attempts(spark, sf), ["job_id"], ["l_linenumber", "attempt_key"], "attempt_number"))
    return reports.with_children(E.jobs(spark, sf).select("job_id", "status"), "job_id", {
        "event": (E.operation_events(spark, sf), "event_seq", ["component", "status"]),
        "attempt": (att, "attempt_number", ["status", "error_type"]),
        "error": (E.import_errors(spark, sf), None, ["error_code", "field_name", "message"]),
        "snapshot": (E.job_snapshots(spark, sf), "source_row", ["product_id", "on_hand"]),
    })


@register("order_missing_products", """
SELECT l.order_id, l.product_id FROM e_order_lines l ANTI JOIN e_products p USING (product_id)
""", ["e_order_lines", "e_products"])
def q_order_missing_products(spark, sf):
    """Order lines whose product does not exist."""
    return E.order_lines(spark, sf).join(E.products(spark, sf), "product_id", "left_anti").select(
        "order_id", "product_id")


@register("missing_product_ids", """
SELECT DISTINCT product_id FROM e_order_lines EXCEPT SELECT product_id FROM e_products
""", ["e_order_lines", "e_products"])
def q_missing_product_ids(spark, sf):
    """H2: requested product ids minus existing ones (set form)."""
    return E.order_lines(spark, sf).select("product_id").subtract(E.products(spark, sf).select("product_id"))


@register("shipment_supplier_mismatch", """
SELECT s.shipment_id, s.order_id, s.supplier_id AS shipment_supplier_id, o.supplier_id AS order_supplier_id
FROM e_order_shipments s JOIN e_orders o ON o.order_id = s.order_id AND o.supplier_id <> s.supplier_id
""", ["e_order_shipments", "e_orders"])
def q_shipment_supplier_mismatch(spark, sf):
    """Shipments whose supplier differs from the order's (equi-join + residual)."""
    s = E.order_shipments(spark, sf)
    o = E.purchase_orders(spark, sf).select("order_id", F.col("supplier_id").alias("order_supplier_id"))
    return s.join(o, (s.order_id == o.order_id) & (s.supplier_id != o.order_supplier_id)).select(
        "shipment_id", s.order_id, F.col("supplier_id").alias("shipment_supplier_id"), "order_supplier_id")


@register("replay_lineage", """
WITH RECURSIVE chain(job_id, ancestor_id, hops) AS (
  SELECT job_id, replay_of_job_id, 1 FROM e_jobs WHERE replay_of_job_id IS NOT NULL
  UNION ALL
  SELECT c.job_id, j.replay_of_job_id, c.hops + 1
  FROM chain c JOIN e_jobs j ON j.job_id = c.ancestor_id WHERE j.replay_of_job_id IS NOT NULL),
d AS (SELECT job_id, arg_max(ancestor_id, hops) AS root_job_id, max(hops) AS hops FROM chain GROUP BY job_id)
SELECT d.job_id, j.replay_of_job_id, d.root_job_id, d.hops,
       (o.status = 'failed' AND o.payload_size IS NOT NULL) AS valid_replay
FROM d JOIN e_jobs j ON j.job_id = d.job_id LEFT JOIN e_jobs o ON o.job_id = j.replay_of_job_id
""", ["e_jobs"])
def q_replay_lineage(spark, sf):
    """Replay chains to their root; only failed originals with payload are replayable."""
    return reports.replay_lineage(spark, E.jobs(spark, sf))


@register("import_summary", f"""
SELECT j.job_id, upper(trim(s.code)) AS supplier_code, j.source_type, j.status, j.accepted_records,
       j.rejected_records, j.attempt_count, j.correlation_id, {_ISO.format(c='j.created_at')} AS created_at,
       {_ISO.format(c='j.completed_at')} AS completed_at
FROM e_jobs j LEFT JOIN e_suppliers s USING (supplier_id)
""", ["e_jobs", "e_suppliers"])
def q_import_summary(spark, sf):
    """Job with its supplier code."""
    j = E.jobs(spark, sf).join(
        E.suppliers(spark, sf).select("supplier_id", X.normalize_code("code").alias("supplier_code")),
        "supplier_id", "left")
    return j.select("job_id", "supplier_code", "source_type", "status", "accepted_records", "rejected_records",
                    "attempt_count", "correlation_id", _iso("created_at"), _iso("completed_at"))


@register("resolve_supplier", """
SELECT j.supplier_id, count(*) AS jobs, s.supplier_id IS NOT NULL AS supplier_found
FROM e_jobs j LEFT JOIN e_suppliers s USING (supplier_id) GROUP BY j.supplier_id, s.supplier_id
""", ["e_jobs", "e_suppliers"])
def q_resolve_supplier(spark, sf):
    """Supplier references resolved against the directory (unknown -> not found)."""
    per = E.jobs(spark, sf).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("jobs"))
    known = E.suppliers(spark, sf).select("supplier_id", F.lit(True).alias("supplier_found"))
    return per.join(known, "supplier_id", "left").fillna(False, subset=["supplier_found"])


@register("import_status_counts", "SELECT status, count(*) AS job_count FROM e_jobs GROUP BY status", ["e_jobs"])
def q_import_status_counts(spark, sf):
    """Jobs per status."""
    return E.jobs(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("job_count"))


def _entity_counts(spark, sf):
    """Rows per entity. Snapshots and the positions they make are counted by
    one aggregate over (warehouse, product) of the columns that acceptance depends on."""
    narrow = views.feed_records(spark, sf, ["supplier_id", "external_sku"]).select(
        *imports.SOURCE_KEY, "job_seq", "source_row", "source_unit", "units_per_source_unit")
    found = imports.accepted(narrow, views.product_map(spark, sf, dealt=True), views.warehouse_map(spark, sf))
    per_position = found.groupBy("warehouse_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_position.agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("s"))
    stored = store(totals, "snapshot-counts").select(
        F.expr("stack(2, 'inventory_positions', p, 'inventory_snapshots', s) as (entity, row_count)"))
    return reports.entity_counts({
        "suppliers": E.suppliers(spark, sf), "products": E.products(spark, sf), "warehouses": E.warehouses(spark, sf),
        "analytics_runs": E.analytics_runs(spark, sf), "operation_events": E.operation_events(spark, sf),
    }).unionByName(stored)


_ENTITY_SQL = """
SELECT 'suppliers' AS entity, count(*) AS row_count FROM e_suppliers
UNION ALL SELECT 'products', count(*) FROM e_products
UNION ALL SELECT 'warehouses', count(*) FROM e_warehouses
UNION ALL SELECT 'inventory_positions', count(*) FROM (SELECT DISTINCT warehouse_id, product_id FROM v_snapshots)
UNION ALL SELECT 'inventory_snapshots', count(*) FROM v_snapshots
UNION ALL SELECT 'analytics_runs', count(*) FROM e_runs
UNION ALL SELECT 'operation_events', count(*) FROM e_op_events
"""


@register("entity_counts", _ENTITY_SQL,
          ["e_suppliers", "e_products", "e_warehouses", "v_snapshots", "e_runs", "e_op_events"])
def q_entity_counts(spark, sf):
    """Row counts of seven hub tables."""
    return _entity_counts(spark, sf)


@register("order_duplicate_products", """
SELECT order_id, product_id, count(*) AS line_count FROM e_order_lines GROUP BY ALL HAVING count(*) > 1
""", ["e_order_lines"])
def q_order_duplicate_products(spark, sf):
    """Orders naming the same product twice."""
    return E.order_lines(spark, sf).groupBy("order_id", "product_id").agg(
        F.count(F.lit(1)).alias("line_count")).where("line_count > 1")


@register("manifest_object_counts", """
SELECT manifest_key, status, CAST(coalesce(len(curated_keys), 0) AS INTEGER) AS curated_object_count,
       CAST(coalesce(len(summary_keys), 0) AS INTEGER) AS summary_object_count
FROM e_manifests
""", ["e_manifests"])
def q_manifest_object_counts(spark, sf):
    """Curated / summary object counts per manifest."""
    return reports.manifest_object_counts(E.manifests(spark, sf))


@register("attempt_numbers", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber, attempt_key) AS attempt_number
           FROM e_attempts)
SELECT job_id, count(*) AS attempts,
       arg_max(CASE WHEN error_type IS NULL THEN 'succeeded'
                    WHEN error_type IN ('OperationalError', 'TransientImportError', 'TimeoutError', 'ConnectionError')
                    THEN 'retry_scheduled' ELSE 'failed' END, attempt_number) AS final_status
FROM a GROUP BY job_id
""", ["e_attempts"])
def q_attempt_numbers(spark, sf):
    """attempt numbers as a running count; final status from the last attempt."""
    a = reports.attempt_outcomes(reports.sequence_numbers(
        E.attempts(spark, sf), ["job_id"], ["l_linenumber", "attempt_key"], "attempt_number"))
    return reports.final_attempt_status(a)


@register("idempotent_submissions", """
WITH f AS (SELECT supplier_id, source_type, idempotency_key,
                  arg_min(job_id, (created_at, job_key)) AS original_job_id,
                  arg_min(content_sha256, (created_at, job_key)) AS h
           FROM e_jobs GROUP BY ALL)
SELECT j.job_id, j.supplier_id, j.source_type, j.idempotency_key, f.original_job_id,
       CASE WHEN j.job_id = f.original_job_id THEN 'created' WHEN j.content_sha256 = f.h THEN 'duplicate'
            ELSE 'conflict' END AS outcome
FROM e_jobs j JOIN f USING (supplier_id, source_type, idempotency_key)
""", ["e_jobs"])
def q_idempotent_submissions(spark, sf):
    """F8: created / duplicate (same hash) / conflict (different hash) per submission."""
    return reports.idempotent_submissions(E.jobs(spark, sf))


@register("latest_manifest", f"""
SELECT partition_date, arg_max(run_id, created_at) AS run_id, arg_max(manifest_key, created_at) AS manifest_key,
       {_ISO.format(c='max(created_at)')} AS created_at
FROM e_manifests GROUP BY partition_date
""", ["e_manifests"])
def q_latest_manifest(spark, sf):
    """newest run per partition date (the ``latest`` pointer)."""
    m = E.manifests(spark, sf).select("partition_date", "run_id", "manifest_key", "created_at")
    return reports.latest_per(m, ["partition_date"], "created_at").select(
        "partition_date", "run_id", "manifest_key", _iso("created_at"))


@register("paginate", """
SELECT warehouse_id, product_id, on_hand_quantity, reserved_quantity, version FROM (
  SELECT warehouse_id, product_id,
         arg_max(on_hand_quantity, (job_seq, source_row)) AS on_hand_quantity,
         arg_max(reserved_quantity, (job_seq, source_row)) AS reserved_quantity,
         CAST(count(*) AS INTEGER) AS version
  FROM v_snapshots GROUP BY warehouse_id, product_id)
ORDER BY warehouse_id, product_id LIMIT 50 OFFSET 100
""", ["v_snapshots"])
def q_paginate(spark, sf):
    """Third page (offset 100, limit 50) of positions by (warehouse, product)."""
    return reports.paginate(_positions(spark, sf), [F.col("warehouse_id"), F.col("product_id")], 100, 50)


@register("recent_imports", f"""
SELECT job_id, status, {_ISO.format(c='created_at')} AS created_at FROM e_jobs
ORDER BY created_at DESC, job_key DESC LIMIT 8
""", ["e_jobs"])
def q_recent_imports(spark, sf):
    """The eight newest import jobs."""
    j = reports.top_k(E.jobs(spark, sf), [F.desc("created_at"), F.desc("job_key")], 8)
    return j.select("job_id", "status", _iso("created_at"))


@register("recent_events", f"""
SELECT event_id, component, status, {_ISO.format(c='occurred_at')} AS occurred_at FROM e_op_events
ORDER BY e_op_events.occurred_at DESC, event_seq DESC LIMIT 12
""", ["e_op_events"])
def q_recent_events(spark, sf):
    """The twelve newest operation events."""
    e = reports.top_k(E.operation_events(spark, sf), [F.desc("occurred_at"), F.desc("event_seq")], 12)
    return e.select("event_id", "component", "status", _iso("occurred_at"))


@register("recent_analytics_runs", f"""
SELECT run_id, run_type, engine, {_ISO.format(c='created_at')} AS created_at FROM e_runs
ORDER BY e_runs.created_at DESC, run_id DESC LIMIT 20
""", ["e_runs"])
def q_recent_analytics_runs(spark, sf):
    """The twenty newest analytics runs."""
    r = reports.top_k(E.analytics_runs(spark, sf), [F.desc("created_at"), F.desc("run_id")], 20)
    return r.select("run_id", "run_type", "engine", _iso("created_at"))


@register("order_errors", """
WITH e AS (SELECT import_job_id, source_row, code, field_name FROM sb_adapter_errors
           UNION ALL
           SELECT import_job_id, source_row, error_code, field_name FROM sb_verdicts WHERE NOT accepted)
SELECT import_job_id, source_row, code, field_name,
       CAST(row_number() OVER (PARTITION BY import_job_id ORDER BY source_row ASC NULLS LAST, field_name, code)
            AS INTEGER) AS position
FROM e
""", ["sb_adapter_errors", "sb_verdicts"])
def q_order_errors(spark, sf):
    """A job's errors by source row (file-level errors, with no row, last)."""
    from skuflow.plans.q_sources import q_all_import_errors

    errs = q_all_import_errors(spark, sf)
    return reports.sequence_numbers(errs, ["import_job_id"],
                                    [F.col("source_row").asc_nulls_last(), "field_name", "code"], "position")


@register("events_after_cursor", f"""
WITH c AS (SELECT occurred_at AS t, event_id AS id FROM e_op_events
           WHERE event_seq = (SELECT max(event_seq) // 2 FROM e_op_events))
SELECT e.event_id, {_ISO.format(c='e.occurred_at')} AS occurred_at FROM e_op_events e, c
WHERE e.occurred_at >= c.t AND e.event_id <> c.id
""", ["e_op_events"])
def q_events_after_cursor(spark, sf):
    """Events at or after the cursor event's time, except the cursor itself."""
    ev = E.operation_events(spark, sf)
    mid = ev.agg(F.floor(F.max("event_seq") / 2).alias("_mid"))
    cursor = ev.join(F.broadcast(mid), ev.event_seq == mid._mid).select(
        F.col("occurred_at").alias("_t"), F.col("event_id").alias("_id"))
    out = attach_scalars(ev, exactly_one(cursor, "cursor event")).where((F.col("occurred_at") >= F.col("_t")) & (F.col("event_id") != F.col("_id")))
    return out.select("event_id", _iso("occurred_at"))


@register("jobs_due", f"""
SELECT job_id, {_ISO.format(c='created_at')} AS created_at FROM e_jobs
WHERE status = 'queued' AND (next_retry_at IS NULL OR next_retry_at <= {{as_of}})
  AND (dispatched_at IS NULL OR dispatched_at <= {{as_of}} - INTERVAL 60 SECOND)
ORDER BY e_jobs.created_at, job_key LIMIT 100
""".replace("{as_of}", "TIMESTAMP '2001-06-01 00:00:00'"), ["e_jobs"])
def q_jobs_due(spark, sf):
    """Dispatch backlog as of a fixed instant (oldest 100)."""
    return reports.jobs_due(E.jobs(spark, sf), E.AS_OF).select("job_id", _iso("created_at"))


@register("stale_leases", """
SELECT job_id, attempt_count, max_attempts,
       CASE WHEN attempt_count < max_attempts THEN 'queued' ELSE 'failed' END AS next_status,
       'abandoned' AS attempt_status, 'worker_lease_expired' AS failure_code
FROM e_jobs WHERE status = 'processing' AND lease_expires_at IS NOT NULL
  AND lease_expires_at < TIMESTAMP '2001-06-01 00:00:00'
""", ["e_jobs"])
def q_stale_leases(spark, sf):
    """Processing jobs with an expired lease and their recovered state."""
    return reports.stale_leases(E.jobs(spark, sf), E.AS_OF)


@register("filter_reconciliations", """
SELECT record_index, product_sku, warehouse_code, difference_quantity FROM v_recon WHERE NOT matches
ORDER BY record_index LIMIT 1000
""", ["v_recon"])
def q_filter_reconciliations(spark, sf):
    """C20 (+G2): one run's mismatches, first page by record index."""
    from skuflow.operators import reconcile

    supplier, hub = views.recon_sides(spark, sf)
    r = reconcile.reconcile(supplier, hub).where(~F.col("matches"))
    return reports.paginate(r, [F.col("record_index")], 0, 1000).select(
        "record_index", "product_sku", "warehouse_code", "difference_quantity")


@register("filter_stockout_risks", """
SELECT record_index, product_sku, CAST(shortage_ratio AS DECIMAL(18,6)) AS shortage_ratio FROM g_curated
WHERE severity = 'high' ORDER BY record_index LIMIT 1000
""", ["g_curated"])
def q_filter_stockout_risks(spark, sf):
    """C21 (+G2): one run's high-severity risks, first page by record index."""
    from skuflow.operators import risk
    from skuflow.plans.oracle_views import SEED
    from skuflow.sources import synthetic


    curated, _ = risk.score(materialize(synthetic.risk_inputs(views.order_index(spark, sf), SEED)), "exact")
    page = reports.paginate(curated.where(F.col("severity") == "high"), [F.col("record_index")], 0, 1000)
    return page.select("record_index", "product_sku", F.col("shortage_ratio").cast("decimal(18,6)")
                       .alias("shortage_ratio"))


@register("filter_inventory", """
SELECT warehouse_id, product_id, arg_max(on_hand_quantity, (job_seq, source_row)) AS on_hand_quantity
FROM v_snapshots WHERE warehouse_id = 'WH-3' GROUP BY warehouse_id, product_id
""", ["v_snapshots"])
def q_filter_inventory(spark, sf):
    """Positions of one warehouse (optional product filter)."""
    p = _positions(spark, sf)
    return p.where(F.col("warehouse_id") == "WH-3").select("warehouse_id", "product_id", "on_hand_quantity")


_RETRYABLE = "('OperationalError', 'TransientImportError', 'TimeoutError', 'ConnectionError')"


@register("classify_import_failure", f"""
SELECT job_id, attempt_key, error_type, error_type IN {_RETRYABLE} AS retryable,
       CASE error_type WHEN 'OperationalError' THEN 'transient_database_error'
            WHEN 'TransientImportError' THEN 'transient_import_error' WHEN 'TimeoutError' THEN 'transient_timeout'
            WHEN 'ConnectionError' THEN 'transient_connection_error'
            WHEN 'PermanentImportError' THEN 'permanent_import_error' ELSE 'unexpected_import_error' END
         AS failure_code
FROM e_attempts WHERE error_type IS NOT NULL
""", ["e_attempts"])
def q_classify_import_failure(spark, sf):
    """Error type -> (retryable, code) over the attempt log."""
    a = E.attempts(spark, sf).where(F.col("error_type").isNotNull())
    retry, code = X.classify_failure("error_type")
    return a.select("job_id", "attempt_key", "error_type", retry.alias("retryable"), code.alias("failure_code"))


@register("retry_delay_seconds", f"""
WITH a AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY l_linenumber, attempt_key) AS INTEGER)
                        AS attempt_number
           FROM e_attempts)
SELECT job_id, attempt_number,
       CAST(least(2 * pow(2, greatest(attempt_number - 1, 0)), 60) AS INTEGER) AS retry_delay_seconds
FROM a WHERE error_type IN {_RETRYABLE}
""", ["e_attempts"])
def q_retry_delay_seconds(spark, sf):
    """min(2 * 2^(n-1), 60) seconds for retryable attempts."""
    a = reports.attempt_outcomes(reports.sequence_numbers(
        E.attempts(spark, sf), ["job_id"], ["l_linenumber", "attempt_key"], "attempt_number"))
    return a.where("retryable").select("job_id", "attempt_number", "retry_delay_seconds")


@register("hub_overview", f"""
SELECT 'status' AS section, status AS item, count(*) AS value FROM e_jobs GROUP BY status
UNION ALL SELECT 'entity', entity, row_count FROM ({_ENTITY_SQL})
UNION ALL SELECT 'recent_import', job_id, rank FROM (
  SELECT job_id, row_number() OVER (ORDER BY created_at DESC, job_key DESC) AS rank FROM e_jobs) WHERE rank <= 8
UNION ALL SELECT 'recent_event', event_id, rank FROM (
  SELECT event_id, row_number() OVER (ORDER BY occurred_at DESC, event_seq DESC) AS rank FROM e_op_events)
  WHERE rank <= 12
""", ["e_jobs", "e_suppliers", "e_products", "e_warehouses", "v_snapshots", "e_runs", "e_op_events"])
def q_hub_overview(spark, sf):
    """Status counts + entity counts + recent imports + recent events."""
    jobs = E.jobs(spark, sf)
    status = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("status").alias("section"), F.col("status").alias("item"), "value")
    ent = _entity_counts(spark, sf).select(
        F.lit("entity").alias("section"), F.col("entity").alias("item"), F.col("row_count").alias("value"))
    recent = reports.top_k(jobs, [F.desc("created_at"), F.desc("job_key")], 8).select(
        F.lit("recent_import").alias("section"), F.col("job_id").alias("item"),
        F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("job_key")))
        .cast("bigint").alias("value"))
    ev = reports.top_k(E.operation_events(spark, sf), [F.desc("occurred_at"), F.desc("event_seq")], 12).select(
        F.lit("recent_event").alias("section"), F.col("event_id").alias("item"),
        F.row_number().over(Window.orderBy(F.desc("occurred_at"), F.desc("event_seq")))
        .cast("bigint").alias("value"))
    return status.unionByName(ent).unionByName(recent).unionByName(ev)
