"""Partner source / adapter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions.scalars import utc_iso, utc_iso_micros
from skuflow.operators import imports, partners
from skuflow.plans.catalog import register
from skuflow.session import store
from skuflow.sources import views

_REC = ("file_id, source_reference, source_row, external_sku, external_location, "
        "strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, source_unit, on_hand_quantity, "
        "reserved_quantity, units_per_source_unit")


def _b(spark, sf, once=None):
    rows = views.supplier_b_lines(spark, sf).withColumn("fields", partners.csv_fields(F.col("text"))).drop("text")
    return partners.parse_supplier_b(rows, once, fragments=False)


@register("scan_supplier_b_csv", f"SELECT {_REC} FROM sb_records", ["sb_records"])
def q_scan_supplier_b_csv(spark, sf):
    """A4: supplier B lines -> canonical records (header by name, any order)."""
    records, _ = _b(spark, sf)
    return records.withColumn("observed_at", utc_iso("observed_at"))


@register("validate_supplier_b_fields",
          "SELECT file_id, source_row, field_name, 'invalid_csv_field' AS code FROM sb_field_errors",
          ["sb_field_errors"])
def q_validate_supplier_b_fields(spark, sf):
    """One error row per bad field; the row is dropped."""
    _, errors = _b(spark, sf)
    return errors.where(F.col("code") == "invalid_csv_field").select("file_id", "source_row", "field_name", "code")


@register("missing_headers", """
SELECT file_id, array_to_string(missing, ', ') AS missing_headers FROM sb_headers WHERE len(missing) > 0
""", ["sb_headers"])
def q_missing_headers(spark, sf):
    """H1: sorted(required - present) per file; such files yield no rows."""
    _, errors = _b(spark, sf)
    return errors.where(F.col("code") == "missing_csv_headers").select(
        "file_id", F.regexp_replace("message", "^The CSV is missing required headers: ", "").alias("missing_headers"))


def _b_verdicts(spark, sf):
    records, adapter_errors = _b(spark, sf, once=lambda df: store(df, "supplier-b"))
    feed = records.select(
        F.col("file_id").alias("import_job_id"), F.lit(1).alias("job_seq"),
        F.concat(F.lit("SUP-"), F.substring("file_id", 3, 20)).alias("supplier_id"),
        "source_reference", "source_row", "external_sku", "external_location", "observed_at", "source_unit",
        "on_hand_quantity", "reserved_quantity", "units_per_source_unit")
    v = imports.verdicts(feed, views.product_map(spark, sf), views.warehouse_map(spark, sf),
                         once=lambda df: store(df, "claims"))
    adapter = adapter_errors.select(F.col("file_id").alias("import_job_id"), "source_row", "code", "field_name")
    return v, adapter


@register("stream_supplier_imports", """
SELECT import_job_id, coalesce(accepted, 0) AS accepted_records, rejected AS rejected_records,
       coalesce(accepted, 0) + rejected AS total_records,
       CASE WHEN rejected = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status
FROM (
  SELECT import_job_id, sum(CAST(accepted AS INTEGER))::BIGINT AS accepted,
         count(DISTINCT CASE WHEN NOT accepted THEN source_row END) + max(CAST(file_error AS INTEGER)) AS rejected
  FROM (SELECT import_job_id, accepted, source_row, false AS file_error FROM sb_verdicts
        UNION ALL
        SELECT import_job_id, false, source_row, source_row IS NULL FROM sb_adapter_errors)
  GROUP BY import_job_id)
""", ["sb_verdicts", "sb_adapter_errors"])
def q_stream_supplier_imports(spark, sf):
    """J4, its batch twin: the plan that each micro-batch runs, over all supplier
    B files at once (adapter -> verdicts -> accounting per job)."""
    return imports.accounting(*_b_verdicts(spark, sf))


@register("all_import_errors", """
SELECT import_job_id, source_row, code, field_name FROM sb_adapter_errors
UNION ALL
SELECT import_job_id, source_row, error_code AS code, field_name FROM sb_verdicts WHERE NOT accepted
""", ["sb_adapter_errors", "sb_verdicts"])
def q_all_import_errors(spark, sf):
    """H4: supplier B adapter errors union apply-time errors of its records."""
    v, adapter = _b_verdicts(spark, sf)
    return imports.all_errors(adapter, imports.rejects(v))


def _a(spark, sf):
    return partners.parse_supplier_a(views.supplier_a_payloads(spark, sf))


@register("scan_supplier_a_json", """
SELECT payload_id, source_reference, source_row, external_sku, external_location,
       strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, source_unit, on_hand_quantity, reserved_quantity
FROM sa_records
""", ["sa_records"])
def q_scan_supplier_a_json(spark, sf):
    """A3: snapshot JSON -> items with 1-based source_row, allocated default 0."""
    records, _ = _a(spark, sf)
    return records.select("payload_id", "source_reference", "source_row", "external_sku", "external_location",
                          utc_iso("observed_at").alias("observed_at"), "source_unit", "on_hand_quantity",
                          "reserved_quantity")


@register("validate_supplier_a_items", "SELECT payload_id, field_name FROM sa_item_errors", ["sa_item_errors"])
def q_validate_supplier_a_items(spark, sf):
    """C11: field rules on every item; any failure invalidates the payload."""
    _, errors = _a(spark, sf)
    return errors.select("payload_id", "field_name")


@register("scan_carrier_events", """
SELECT arrival_seq, external_event_id, tracking_reference, event_type,
       strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at, reason_code
FROM cc_events
""", ["cc_events"])
def q_scan_carrier_events(spark, sf):
    """A5: carrier JSON -> canonical event (lower-case type, enum, tz required, UTC)."""
    events, _ = partners.parse_carrier_events(views.carrier_raw(spark, sf))
    return events.withColumn("occurred_at", utc_iso_micros("occurred_at"))


@register("require_timezone", "SELECT arrival_seq, external_event_id, field_name FROM cc_rejects", ["cc_rejects"])
def q_require_timezone(spark, sf):
    """C14 (+ enum check): rejected carrier events and the failing field."""
    _, rejects = partners.parse_carrier_events(views.carrier_raw(spark, sf))
    return rejects.select("arrival_seq", "external_event_id", "field_name")


def _published_history(spark, sf):
    """The raw history published as date-partitioned CSV in a new folder of the
    shared scratch space (what A1 and A2 read)."""
    from skuflow.session import scratch_path
    from skuflow.sources import files

    root = scratch_path(spark, "history-csv")
    files.write_history_csv(views.v_inv_raw(spark, sf), root)
    return root


@register("scan_history_csv", """
SELECT event_date, supplier_code, product_sku, warehouse_code, on_hand_quantity, reserved_quantity,
       inbound_quantity, forecast_quantity, actual_demand_quantity
FROM v_inv_raw
""", ["v_inv_raw"])
def q_scan_history_csv(spark, sf):
    """A1: history published as date-partitioned CSV in the shared scratch
    folder, read back with the declared schema (blank keys, NULLs kept)."""
    from skuflow.sources import files

    root = _published_history(spark, sf)
    return files.scan_history_csv(spark, root).select(
        "event_date", "supplier_code", "product_sku", "warehouse_code", "on_hand_quantity", "reserved_quantity",
        "inbound_quantity", "forecast_quantity", "actual_demand_quantity")


@register("source_partition_inventory")
def q_source_partition_inventory(spark, sf):
    """A2: CSV objects per event_date partition (rows-only: file layout is the writer's)."""
    from skuflow.sources import files

    return files.partition_inventory(spark, _published_history(spark, sf))


@register("scan_pipeline_manifests", """
SELECT manifest_key, status, partition_date, run_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, input_rows,
       CAST(len(curated_keys) AS INTEGER) AS curated_object_count,
       CAST(len(summary_keys) AS INTEGER) AS summary_object_count, '4.1' AS spark_version
FROM e_manifests ORDER BY manifest_key DESC LIMIT 20
""", ["e_manifests"])
def q_scan_pipeline_manifests(spark, sf):
    """The run catalogue read back from manifest documents, one object per
    run (plus planted latest pointers, non-object and undecodable documents)."""
    from skuflow.session import scratch_path
    from skuflow.sources import entities, files

    m = entities.manifests(spark, sf).withColumn("created_at", utc_iso("created_at"))
    value = F.to_json(F.struct("status", "partition_date", "run_id", "created_at", "input_rows", "curated_keys",
                               "summary_keys", F.lit("4.1").alias("spark_version")))
    name = F.regexp_extract("manifest_key", r"/run_id=([^/]*)$", 1)
    runs = m.select(F.col("partition_date").alias("event_date"), name.alias("run_id"), value.alias("value"))
    junk = spark.createDataFrame([("1900-01-01", "a.json", "[1, 2, 3]"), ("1900-01-01", "b.json", "{not json")], runs.schema)
    root = scratch_path(spark, "manifests")
    # One object per run: spread over tasks, as each of them is a file of its own.
    (runs.unionByName(junk).repartition(32, "event_date", "run_id").write.mode("append").partitionBy("event_date", "run_id")
     .text(f"{root}/manifests/inventory-risk"))
    newest = m.orderBy(F.desc("manifest_key")).limit(1).select("partition_date", value.alias("value"))
    newest.select("value").write.text(f"{root}/manifests/inventory-risk/event_date=9999-12-31/latest.json")
    return files.scan_manifests(spark, root, 20)
