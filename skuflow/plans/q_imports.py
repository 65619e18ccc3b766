"""Partner-import apply queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.operators import imports
from skuflow.plans.catalog import register
from skuflow.session import store
from skuflow.sources import views


def _verdicts(spark, sf):
    return imports.verdicts(views.feed_records(spark, sf), views.product_map(spark, sf),
                            views.warehouse_map(spark, sf), once=lambda df: store(df, "claims"))


def accepted_snapshots(spark, sf, columns=None):
    """Snapshots of all accepted records of the feed (or ``columns`` of them)."""
    found = imports.accepted(views.feed_records(spark, sf, ["supplier_id", "external_sku"]),
                             views.product_map(spark, sf, dealt=True), views.warehouse_map(spark, sf),
                             columns=columns and [*columns, "_map_factor"])
    return imports.snapshots(found, columns)


@register("map_products", """
SELECT import_job_id, source_row, product_id, product_mapping_version, product_id IS NOT NULL AS product_found
FROM v_flagged
""", ["v_flagged"])
def q_map_products(spark, sf):
    """Left lookup of active product mappings by external SKU."""
    f = imports.mapping_flags(views.feed_records(spark, sf), views.product_map(spark, sf),
                              views.warehouse_map(spark, sf))
    return f.select("import_job_id", "source_row", "product_id", "product_mapping_version",
                    F.col("product_id").isNotNull().alias("product_found"))


@register("map_warehouses", """
SELECT import_job_id, source_row, warehouse_id, warehouse_mapping_version,
       warehouse_id IS NOT NULL AS warehouse_found
FROM v_flagged
""", ["v_flagged"])
def q_map_warehouses(spark, sf):
    """D3: left lookup of active warehouse mappings by external location."""
    f = imports.mapping_flags(views.feed_records(spark, sf), views.product_map(spark, sf),
                              views.warehouse_map(spark, sf))
    return f.select("import_job_id", "source_row", "warehouse_id", "warehouse_mapping_version",
                    F.col("warehouse_id").isNotNull().alias("warehouse_found"))


@register("mapping_unit_mismatch", """
SELECT import_job_id, source_row, map_code AS code, source_unit, map_unit, units_per_source_unit, map_factor
FROM v_flagged WHERE map_code IN ('source_unit_mismatch', 'unit_conversion_mismatch')
""", ["v_flagged"])
def q_mapping_unit_mismatch(spark, sf):
    """Record unit differs from the mapping's, or a partner factor differs."""
    f = imports.mapping_flags(views.feed_records(spark, sf), views.product_map(spark, sf),
                              views.warehouse_map(spark, sf))
    return f.where(F.col("_map_code").isin("source_unit_mismatch", "unit_conversion_mismatch")).select(
        "import_job_id", "source_row", F.col("_map_code").alias("code"), "source_unit",
        F.col("_map_unit").alias("map_unit"), "units_per_source_unit", F.col("_map_factor").alias("map_factor"))


@register("duplicate_in_file", """
SELECT import_job_id, source_row, source_reference, external_sku, external_location
FROM v_verdicts WHERE duplicate_in_file
""", ["v_verdicts"])
def q_duplicate_in_file(spark, sf):
    """second and later occurrences of a source key inside one job."""
    return _verdicts(spark, sf).where("duplicate_in_file").select(
        "import_job_id", "source_row", "source_reference", "external_sku", "external_location")


@register("already_imported", """
SELECT import_job_id, source_row, source_reference, external_sku, external_location
FROM v_verdicts WHERE already_imported
""", ["v_verdicts"])
def q_already_imported(spark, sf):
    """An earlier job already accepted a snapshot with the same source key."""
    return _verdicts(spark, sf).where("already_imported").select(
        "import_job_id", "source_row", "source_reference", "external_sku", "external_location")


@register("reject_precedence",
          "SELECT import_job_id, source_row, error_code, field_name, accepted FROM v_verdicts", ["v_verdicts"])
def q_reject_precedence(spark, sf):
    """one verdict per record, first failing rule wins."""
    return _verdicts(spark, sf).select("import_job_id", "source_row", "error_code", "field_name", "accepted")


@register("unit_conversion", """
SELECT import_job_id, source_row, on_hand_quantity, reserved_quantity, units_per_source_unit FROM v_snapshots
""", ["v_snapshots"])
def q_unit_conversion(spark, sf):
    """Canonical quantities = source x mapping factor, DECIMAL(18,3)."""
    return accepted_snapshots(spark, sf).select(
        "import_job_id", "source_row", "on_hand_quantity", "reserved_quantity", "units_per_source_unit")


@register("position_upsert", """
SELECT warehouse_id, product_id,
       arg_max(on_hand_quantity, (job_seq, source_row)) AS on_hand_quantity,
       arg_max(reserved_quantity, (job_seq, source_row)) AS reserved_quantity,
       CAST(count(*) AS INTEGER) AS version
FROM v_snapshots GROUP BY warehouse_id, product_id
""", ["v_snapshots"])
def q_position_upsert(spark, sf):
    """last accepted write per (warehouse, product) wins; version counts writes."""
    return imports.positions(accepted_snapshots(spark, sf))


@register("import_accounting", """
SELECT import_job_id, count(*) FILTER (WHERE accepted) AS accepted_records,
       count(DISTINCT CASE WHEN NOT accepted THEN source_row END) AS rejected_records,
       count(*) FILTER (WHERE accepted) + count(DISTINCT CASE WHEN NOT accepted THEN source_row END)
         AS total_records,
       CASE WHEN count(DISTINCT CASE WHEN NOT accepted THEN source_row END) = 0 THEN 'completed'
            ELSE 'completed_with_errors' END AS status
FROM v_verdicts GROUP BY import_job_id
""", ["v_verdicts"])
def q_import_accounting(spark, sf):
    """Accepted / rejected / total and completion status per job."""
    return imports.accounting(_verdicts(spark, sf))


@register("rejected_row_set", """
SELECT DISTINCT import_job_id, source_row FROM v_verdicts WHERE NOT accepted
""", ["v_verdicts"])
def q_rejected_row_set(spark, sf):
    """H5: distinct rejected source rows."""
    return imports.rejected_row_set(imports.rejects(_verdicts(spark, sf)))


@register("supplier_import", """
SELECT import_job_id, supplier_id, product_id, warehouse_id, source_reference, external_sku, external_location,
       strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, source_row, source_unit, on_hand_quantity,
       reserved_quantity, units_per_source_unit, product_mapping_version, warehouse_mapping_version
FROM v_snapshots
""", ["v_snapshots"])
def q_supplier_import(spark, sf):
    """Canonical records -> verdicts -> accepted snapshots in canonical units."""
    from skuflow.functions.scalars import utc_iso

    s = store(accepted_snapshots(spark, sf), "snapshots")
    return s.drop("job_seq").withColumn("observed_at", utc_iso("observed_at"))


def _pm_versions(spark, sf):
    from skuflow.operators import mappings

    u = views.mapping_upserts(spark, sf)
    return mappings.versions(u, ["external_sku"], ["product_id", "source_unit", "units_per_source_unit", "active"],
                             ["ts", "event_id"])


@register("mapping_versions", "SELECT external_sku, event_id, version FROM v_pm_versions", ["v_pm_versions"])
def q_mapping_versions(spark, sf):
    """product mapping version increments only when an attribute changes."""
    return _pm_versions(spark, sf).select("external_sku", "event_id", "version")


@register("warehouse_mapping_versions", "SELECT external_location, event_id, version FROM v_wm_versions",
          ["v_wm_versions"])
def q_warehouse_mapping_versions(spark, sf):
    """warehouse mapping version increments on warehouse / active changes."""
    from skuflow.operators import mappings

    u = views.mapping_upserts(spark, sf)
    v = mappings.versions(u, ["external_location"], ["warehouse_id", "warehouse_active"], ["ts", "event_id"])
    return v.select("external_location", "event_id", "version")


@register("mapping_version_asof", """
SELECT s.event_id, s.external_sku, v.version AS product_mapping_version,
       v.units_per_source_unit, CAST(s.source_quantity * v.units_per_source_unit AS DECIMAL(18,3))
         AS canonical_quantity
FROM v_mapped_snapshots s
LEFT JOIN v_pm_versions v ON v.external_sku = s.external_sku AND s.applied_at >= v.ts
                         AND (v.valid_to IS NULL OR s.applied_at < v.valid_to)
""", ["v_mapped_snapshots", "v_pm_versions"])
def q_mapping_version_asof(spark, sf):
    """Each snapshot keeps the mapping version and factor in force when applied."""
    from skuflow.functions.scalars import unit_conversion
    from skuflow.operators import mappings

    hist = mappings.intervals(_pm_versions(spark, sf), ["external_sku"], "ts", ["ts", "event_id"])
    j = mappings.as_of(views.mapped_snapshots(spark, sf), hist.drop("event_id"), ["external_sku"], "applied_at",
                       ["version", "units_per_source_unit"])
    return j.select("event_id", "external_sku", F.col("version").alias("product_mapping_version"),
                    "units_per_source_unit",
                    unit_conversion("source_quantity", "units_per_source_unit").alias("canonical_quantity"))
