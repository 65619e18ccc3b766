"""Constraint audits over the hub tables (L1-L6) and their union."""

from __future__ import annotations

import re

from skuflow import schemas as S
from skuflow.operators import audits, imports, reports, risk
from skuflow.plans.catalog import register
from skuflow.plans.q_imports import accepted_snapshots
from skuflow.session import store
from skuflow.sources import entities as E
from skuflow.sources import synthetic, views

# ---------------------------------------------------------------------------
# Declared constraints of the relational model
# ---------------------------------------------------------------------------
CHECKS = {
    "inventory_positions": {"on_hand_nonnegative": "on_hand_quantity >= 0",
                            "reserved_nonnegative": "reserved_quantity >= 0", "version_positive": "version > 0"},
    "purchase_order_lines": {"ordered_positive": "ordered_quantity > 0",
                             "received_nonnegative": "received_quantity >= 0"},
    "supplier_product_mappings": {"factor_positive": "units_per_source_unit > 0", "version_positive": "version > 0"},
    "supplier_warehouse_mappings": {"version_positive": "version > 0"},
    "import_jobs": {"attempt_count_nonnegative": "attempt_count >= 0", "max_attempts_positive": "max_attempts > 0",
                    "payload_size_nonnegative": "payload_size IS NULL OR payload_size >= 0"},
    "import_attempts": {"attempt_number_positive": "attempt_number > 0"},
    "inventory_snapshots": {"on_hand_nonnegative": "on_hand_quantity >= 0",
                            "reserved_nonnegative": "reserved_quantity >= 0",
                            "factor_positive": "units_per_source_unit > 0"},
    "analytics_runs": {"input_rows_positive": "input_rows > 0", "duration_nonnegative": "duration_ms >= 0"},
    "stockout_risks": {"shortage_nonnegative": "projected_shortage_quantity >= 0",
                       "ratio_nonnegative": "shortage_ratio >= 0"},
}
UNIQUES = [
    ("suppliers", "code_unique", ["code"]),
    ("products", "sku_unique", ["sku"]),
    ("warehouses", "code_unique", ["code"]),
    ("inventory_positions", "warehouse_product_unique", ["warehouse_id", "product_id"]),
    ("purchase_orders", "supplier_reference_unique", ["supplier_id", "reference"]),
    ("purchase_order_lines", "order_line_number_unique", ["order_id", "line_number"]),
    ("purchase_order_lines", "order_product_unique", ["order_id", "product_id"]),
    ("shipments", "supplier_tracking_unique", ["supplier_id", "tracking_reference"]),
    ("shipment_events", "shipment_event_unique", ["shipment_id", "external_event_id"]),
    ("supplier_product_mappings", "external_sku_unique", ["supplier_id", "external_sku"]),
    ("supplier_warehouse_mappings", "external_location_unique", ["supplier_id", "external_location"]),
    ("import_jobs", "idempotency_unique", ["supplier_id", "source_type", "idempotency_key"]),
    ("import_attempts", "job_attempt_unique", ["job_id", "attempt_number"]),
    ("inventory_snapshots", "source_record_unique",
     ["supplier_id", "source_reference", "external_sku", "external_location"]),
    ("inventory_reconciliations", "run_record_unique", ["run_id", "record_index"]),
    ("stockout_risks", "run_record_unique", ["run_id", "record_index"]),
]
FOREIGN_KEYS = [
    ("inventory_positions", "warehouse_fk", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory_positions", "product_fk", "product_id", "products", "product_id"),
    ("purchase_orders", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("purchase_order_lines", "order_fk", "order_id", "purchase_orders", "order_id"),
    ("purchase_order_lines", "product_fk", "product_id", "products", "product_id"),
    ("shipments", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("shipments", "order_fk", "order_id", "purchase_orders", "order_id"),
    ("shipment_events", "shipment_fk", "shipment_id", "shipments", "shipment_id"),
    ("supplier_product_mappings", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("supplier_product_mappings", "product_fk", "product_id", "products", "product_id"),
    ("supplier_warehouse_mappings", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("supplier_warehouse_mappings", "warehouse_fk", "warehouse_id", "warehouses", "warehouse_id"),
    ("import_jobs", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("import_jobs", "replay_of_fk", "replay_of_job_id", "import_jobs", "job_id"),
    ("import_attempts", "job_fk", "job_id", "import_jobs", "job_id"),
    ("operation_events", "job_fk", "job_id", "import_jobs", "job_id"),
    ("import_errors", "job_fk", "job_id", "import_jobs", "job_id"),
    ("inventory_snapshots", "job_fk", "import_job_id", "import_jobs", "job_id"),
    ("inventory_snapshots", "supplier_fk", "supplier_id", "suppliers", "supplier_id"),
    ("inventory_snapshots", "product_fk", "product_id", "products", "product_id"),
    ("inventory_snapshots", "warehouse_fk", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory_reconciliations", "run_fk", "run_id", "analytics_runs", "run_id"),
    ("stockout_risks", "run_fk", "run_id", "analytics_runs", "run_id"),
]
ENUMS = [
    ("suppliers", "status", S.RECORD_STATUS),
    ("products", "base_unit", S.UNIT_OF_MEASURE),
    ("products", "status", S.RECORD_STATUS),
    ("warehouses", "status", S.RECORD_STATUS),
    ("purchase_orders", "status", S.PURCHASE_ORDER_STATUS),
    ("shipments", "status", S.SHIPMENT_STATUS),
    ("shipment_events", "event_type", S.SHIPMENT_EVENT_TYPE),
    ("supplier_product_mappings", "source_unit", S.UNIT_OF_MEASURE),
    ("import_jobs", "source_type", S.IMPORT_SOURCE_TYPE),
    ("import_jobs", "status", S.IMPORT_STATUS),
    ("import_attempts", "status", S.IMPORT_ATTEMPT_STATUS),
    ("inventory_snapshots", "source_unit", S.UNIT_OF_MEASURE),
    ("analytics_runs", "run_type", S.ANALYTICS_RUN_TYPE),
    ("analytics_runs", "engine", S.ANALYTICS_ENGINE),
    ("stockout_risks", "severity", S.RISK_SEVERITY),
]
LENGTHS = {
    "suppliers": {"code": 50, "name": 200},
    "products": {"sku": 100, "name": 200},
    "warehouses": {"code": 50, "name": 200, "timezone": 100},
    "purchase_orders": {"reference": 100},
    "shipments": {"tracking_reference": 100},
    "shipment_events": {"external_event_id": 100, "reason_code": 100},
    "supplier_product_mappings": {"external_sku": 100},
    "supplier_warehouse_mappings": {"external_location": 100},
    "import_jobs": {"adapter_version": 100, "original_filename": 255, "content_sha256": 64, "content_type": 100,
                    "payload_object_key": 1000, "idempotency_key": 128, "correlation_id": 128, "worker_id": 255,
                    "failure_code": 100, "failure_message": 1000},
    "import_attempts": {"celery_task_id": 255, "worker_id": 255, "error_code": 100, "error_message": 1000},
    "operation_events": {"correlation_id": 128, "component": 50, "stage": 100, "status": 30, "title": 200,
                         "explanation": 1000, "evidence_reference": 1000},
    "import_errors": {"error_code": 100, "field_name": 100, "message": 500},
    "inventory_snapshots": {"source_reference": 100, "external_sku": 100, "external_location": 100},
    "inventory_reconciliations": {"supplier_code": 100, "product_sku": 100, "warehouse_code": 100},
    "stockout_risks": {"product_sku": 100, "warehouse_code": 100},
}
# Tables whose rows come partitioned by these columns: numbered within their parent, or one row per key.
DEALT = {"purchase_order_lines": ["order_id"], "import_attempts": ["job_id"],
         "inventory_positions": ["warehouse_id", "product_id"], "supplier_product_mappings": ["supplier_id", "external_sku"]}
FAMILIES = ("check", "unique", "foreign_key", "enum", "length")
TABLE_NAMES = sorted({*CHECKS, *LENGTHS, *(u[0] for u in UNIQUES), *(e[0] for e in ENUMS)})

# Columns that only the audits read, derived from each entity's own columns
# (expressions that Spark and the oracle both understand); violations are planted.
EXTRA = {
    "suppliers": {"status": "CASE WHEN balance < 0 THEN 'inactive' WHEN balance > 9000 THEN 'blocked' ELSE 'active' END"},
    "products": {"base_unit": "CASE WHEN name LIKE '%e' THEN 'EACH' WHEN name LIKE '%t' THEN 'BARREL' ELSE 'CASE' END",
                 "status": "CASE WHEN sku LIKE '%7' THEN 'inactive' ELSE 'active' END"},
    "warehouses": {"status": "CASE WHEN code LIKE '%a' THEN 'inactive' ELSE 'active' END"},
    "shipments": {"status": "CASE WHEN tracking_reference LIKE '%3' THEN 'delivered' "
                            "WHEN tracking_reference LIKE '%99' THEN 'lost' ELSE 'planned' END"},
    "import_jobs": {
        "adapter_version": "concat(source_type, '.v1')", "original_filename": "concat('feed-', job_id, '.csv')",
        "content_type": "CASE WHEN source_type = 'supplier_b_csv' THEN 'text/csv' ELSE 'application/json' END",
        "payload_object_key": "concat('raw/inventory/', content_sha256)", "worker_id": "concat('worker-', supplier_id)",
        "failure_code": "CASE WHEN status = 'failed' THEN concat('code-', repeat('x', 20 * attempt_count + 38)) END",
        "failure_message": "CASE WHEN status = 'failed' THEN concat('job ', job_id, ' failed') END"},
    "import_attempts": {
        "celery_task_id": "concat('task-', job_id)", "worker_id": "concat('worker-', job_id)",
        "error_code": "lower(error_type)", "error_message": "concat('attempt ended with ', error_type)"},
    "operation_events": {
        "correlation_id": "concat('corr-', event_id)", "stage": "concat(component, '.done')",
        "title": "concat('Event ', event_id)", "explanation": "details", "evidence_reference": "concat('events/', event_id)"},
    "stockout_risks": {"run_id": "'RUN-1'"},
}

# Oracle view per audited table.
DUCK = {
    "inventory_positions": "e_positions", "purchase_order_lines": "e_lines_numbered",
    "supplier_product_mappings": "v_product_map", "supplier_warehouse_mappings": "v_warehouse_map",
    "import_jobs": "e_jobs", "import_attempts": "e_attempts_numbered", "inventory_snapshots": "v_snapshots",
    "analytics_runs": "e_runs", "stockout_risks": "g_curated", "suppliers": "e_suppliers",
    "products": "e_products", "warehouses": "e_warehouses", "purchase_orders": "e_orders",
    "shipments": "e_order_shipments", "operation_events": "e_op_events", "shipment_events": "e_shipment_events",
    "import_errors": "e_import_errors", "inventory_reconciliations": "e_reconciliations",
}
def _columns(table: str, families: tuple[str, ...] = FAMILIES) -> list[str]:
    """The columns that some rule of the families reads in the table (or derives one from)."""
    read = {
        "unique": {c for t, _, keys in UNIQUES if t == table for c in keys},
        "length": set(LENGTHS.get(table, {})),
        "enum": {c for t, c, _ in ENUMS if t == table},
        "foreign_key": {c for t, _, c, _, _ in FOREIGN_KEYS if t == table} | {c for _, _, _, t, c in FOREIGN_KEYS if t == table},
        "check": set(re.findall(r"[a-z_]+", " ".join(CHECKS.get(table, {}).values()))),
    }
    return sorted(set().union(*[read[f] for f in families]))


def _row_rules(table: str, families: tuple[str, ...]) -> dict[tuple[str, str], str]:
    """``(family, rule) -> SQL condition``: the rules that one row can break."""
    rules: dict[tuple[str, str], str] = {}
    if "check" in families:
        rules |= {("check", n): c for n, c in CHECKS.get(table, {}).items()}
    if "enum" in families:
        rules |= {("enum", f"{c}_enum"): f"{c} IS NULL OR {c} IN ({', '.join(repr(v) for v in dom)})"
                  for t, c, dom in ENUMS if t == table}
    if "length" in families:
        rules |= {("length", f"{c}_length"): f"{c} IS NULL OR length({c}) <= {n}" for c, n in LENGTHS.get(table, {}).items()}
    return rules


class Tables:
    """The audited tables of one audit run, each built when first used."""

    def __init__(self, spark, sf, families: tuple[str, ...]):
        self.spark, self.sf, self.families, self.built = spark, sf, families, {}

    def __getitem__(self, table: str):
        if table not in self.built:
            df = getattr(self, f"_{table}", lambda: getattr(E, table)(self.spark, self.sf))()
            df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in EXTRA.get(table, {}).items()])
            df = df.select(*[c for c in self._wanted(table) if c in df.columns])
            # Positions are made from the snapshots: written once, read by both.
            self.built[table] = store(df, f"audit-{table}") if table == "inventory_snapshots" else df
        return self.built[table]

    def _wanted(self, table: str) -> list[str]:
        wanted = _columns(table, self.families)
        if table == "inventory_snapshots":
            # Positions are made from the snapshots, in the order of job and row.
            wanted += ["warehouse_id", "product_id", "on_hand_quantity", "reserved_quantity", "job_seq", "source_row"]
        return list(dict.fromkeys(wanted))

    def _inventory_snapshots(self):
        return accepted_snapshots(self.spark, self.sf, self._wanted("inventory_snapshots"))

    def _inventory_positions(self):
        return imports.positions(self["inventory_snapshots"])

    def _stockout_risks(self):
        from skuflow.plans.oracle_views import SEED

        inputs = store(synthetic.risk_inputs(views.order_index(self.spark, self.sf), SEED), "risk-inputs")
        return risk.score(inputs, "exact")[0]

    def _import_attempts(self):
        return reports.attempt_outcomes(reports.sequence_numbers(
            E.attempts(self.spark, self.sf), ["job_id"], ["l_linenumber", "attempt_key"], "attempt_number"))

    def _purchase_order_lines(self):
        return reports.sequence_numbers(E.order_lines(self.spark, self.sf, ["order_id"]), ["order_id"], ["input_pos"], "line_number")

    def _supplier_product_mappings(self):
        return views.product_map(self.spark, self.sf, dealt=True)

    def _supplier_warehouse_mappings(self):
        return views.warehouse_map(self.spark, self.sf)

    def _import_jobs(self):
        return E.jobs(self.spark, self.sf)

    def _shipments(self):
        return E.order_shipments(self.spark, self.sf)

    def _inventory_reconciliations(self):
        return E.reconciliations(self.spark, self.sf)


def _audit(spark, sf, families: tuple[str, ...]):
    """``(audit, table_name, rule, violations)`` of the wanted families."""
    rules = audits.Rules({t: _row_rules(t, families) for t in TABLE_NAMES}, UNIQUES if "unique" in families else [],
                         FOREIGN_KEYS if "foreign_key" in families else [], DEALT)
    return audits.violations(spark, rules, Tables(spark, sf, families).__getitem__)


# --- oracle SQL generated from the same declared constraints ------------------
def _source(table: str) -> str:
    extra = EXTRA.get(table)
    if not extra:
        return DUCK[table]
    return f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in extra.items())} FROM {DUCK[table]})"


def _sql(families: tuple[str, ...]) -> str:
    parts = []

    def add(audit, table, rule, count):
        parts.append(f"SELECT '{audit}' AS audit, '{table}' AS table_name, '{rule}' AS rule, {count}")

    for table in TABLE_NAMES:
        for (family, rule), cond in _row_rules(table, families).items():
            add(family, table, rule, f"count(*) FILTER (WHERE NOT ({cond})) AS violations FROM {_source(table)}")
    if "unique" in families:
        for t, name, keys in UNIQUES:
            known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
            add("unique", t, name, f"count(*) AS violations FROM (SELECT {', '.join(keys)} FROM {_source(t)} "
                                   f"WHERE {known} GROUP BY ALL HAVING count(*) > 1)")
    if "foreign_key" in families:
        for t, name, ck, p, pk in FOREIGN_KEYS:
            add("foreign_key", t, name, f"count(*) AS violations FROM {_source(t)} c WHERE c.{ck} IS NOT NULL "
                                        f"AND NOT EXISTS (SELECT 1 FROM {_source(p)} p WHERE p.{pk} = c.{ck})")
    return "\nUNION ALL\n".join(parts)


def _register(key: str, families: tuple[str, ...], doc: str) -> None:
    sql = _sql(families)
    if len(families) == 1:
        sql = f"SELECT table_name, rule, violations FROM ({sql})"

    def query(spark, sf):
        found = _audit(spark, sf, families)
        return found.drop("audit") if len(families) == 1 else found

    query.__name__, query.__doc__ = f"q_{key}", doc
    register(key, sql, sorted(set(DUCK.values())))(query)


_register("audit_checks", ("check",), "L1: rows that break a CHECK rule.")
_register("audit_unique", ("unique",), "L2: key groups with more than one row.")
_register("audit_foreign_keys", ("foreign_key",), "L3: child rows without their parent.")
_register("audit_enums", ("enum",), "L4: values outside an enum's domain.")
_register("audit_lengths", ("length",), "L5: strings longer than declared.")
_register("constraint_audit", FAMILIES, "All declared-constraint audits as (audit, table, rule, violations).")


@register("verify_manifest", """
SELECT manifest_key, status,
       status = 'succeeded' AND coalesce(list_bool_or(list_transform(curated_keys, lambda k: ends_with(k, '.parquet'))), false)
       AND coalesce(list_bool_or(list_transform(summary_keys, lambda k: ends_with(k, '.parquet'))), false) AS verified
FROM e_manifests
""", ["e_manifests"])
def q_verify_manifest(spark, sf):
    """Succeeded manifests whose key lists both hold a Parquet object."""
    return reports.verify_manifests(E.manifests(spark, sf))
