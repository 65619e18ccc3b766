"""Declared schemas and fixed domain values.

Fixed values below must equal the reference behaviour for results to match;
they are stated plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enum domains
# ---------------------------------------------------------------------------
RECORD_STATUS = ["active", "inactive"]
UNIT_OF_MEASURE = ["EACH", "CASE", "PALLET", "KILOGRAM"]
PURCHASE_ORDER_STATUS = ["submitted", "partially_received", "received", "cancelled"]
SHIPMENT_STATUS = ["planned", "picked_up", "in_transit", "delayed", "delivered", "cancelled"]
SHIPMENT_EVENT_TYPE = ["picked_up", "in_transit", "delayed", "delivered", "cancelled"]
IMPORT_STATUS = ["queued", "processing", "completed", "completed_with_errors", "failed"]
IMPORT_ATTEMPT_STATUS = ["running", "succeeded", "retry_scheduled", "failed", "abandoned"]
IMPORT_SOURCE_TYPE = ["supplier_a_json", "supplier_b_csv"]
ANALYTICS_ENGINE = ["pandas", "polars", "numpy"]
ANALYTICS_RUN_TYPE = ["inventory_reconciliation", "stockout_risk"]
RISK_SEVERITY = ["none", "low", "medium", "high"]

# ---------------------------------------------------------------------------
# Shipment lifecycle (current status -> event type -> next status)
# ---------------------------------------------------------------------------
SHIPMENT_TRANSITIONS: list[tuple[str, str, str]] = [
    ("planned", "picked_up", "picked_up"),
    ("planned", "delayed", "delayed"),
    ("planned", "cancelled", "cancelled"),
    ("picked_up", "in_transit", "in_transit"),
    ("picked_up", "delayed", "delayed"),
    ("picked_up", "delivered", "delivered"),
    ("picked_up", "cancelled", "cancelled"),
    ("in_transit", "delayed", "delayed"),
    ("in_transit", "delivered", "delivered"),
    ("in_transit", "cancelled", "cancelled"),
    ("delayed", "in_transit", "in_transit"),
    ("delayed", "delivered", "delivered"),
    ("delayed", "cancelled", "cancelled"),
]
TERMINAL_SHIPMENT_STATUS = ["delivered", "cancelled"]

# ---------------------------------------------------------------------------
# Settings and adapter versions
# ---------------------------------------------------------------------------
IMPORT_RETRY_BASE_SECONDS = 2
IMPORT_RETRY_MAX_SECONDS = 60
IMPORT_REDISPATCH_SECONDS = 60
MAX_SUPPLIER_B_BYTES = 10 * 1024 * 1024
SUPPLIER_A_MAX_ITEMS = 10_000
ADAPTER_VERSIONS = {
    "supplier_a_json": "supplier-a.inventory.v1",
    "supplier_b_csv": "supplier-b.inventory-csv.v1",
    "carrier_c": "carrier-c.shipment-events.v1",
}
SUPPLIER_B_REQUIRED_HEADERS = [
    "snapshot_ref", "as_of", "partner_sku", "depot", "case_count", "units_per_case",
]
# Reconciliation generator delta distribution.
RECONCILIATION_DELTAS = [-20, -8, -3, 0, 0, 0, 0, 4, 9, 25]
THRESHOLD_METHOD_APPROX = "positive shortage-ratio approximate p50 and p80"
THRESHOLD_METHOD_EXACT = "positive shortage-ratio p50 and p80"
RUN_ID_MAX_LENGTH = 180

# Import failure classification: error type -> (retryable, code)
FAILURE_CLASSES: list[tuple[str, bool, str]] = [
    ("OperationalError", True, "transient_database_error"),
    ("TransientImportError", True, "transient_import_error"),
    ("TimeoutError", True, "transient_timeout"),
    ("ConnectionError", True, "transient_connection_error"),
    ("PermanentImportError", False, "permanent_import_error"),
]
UNEXPECTED_FAILURE_CODE = "unexpected_import_error"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
KEY_COLUMNS = ["event_date", "supplier_code", "product_sku", "warehouse_code"]
QUANTITY_COLUMNS = [
    "on_hand_quantity",
    "reserved_quantity",
    "inbound_quantity",
    "forecast_quantity",
    "actual_demand_quantity",
]

HISTORY_SCHEMA = T.StructType(
    [T.StructField("event_date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in KEY_COLUMNS[1:]]
    + [T.StructField(c, T.DoubleType()) for c in QUANTITY_COLUMNS]
)

QTY = T.DecimalType(18, 3)
RATIO = T.DecimalType(18, 6)

SUPPLIER_A_SCHEMA = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("captured_at", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("item_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("on_hand", T.StringType()),
        T.StructField("allocated", T.StringType()),
        T.StructField("unit", T.StringType()),
    ]))),
])

CARRIER_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("tracking_number", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("reason_code", T.StringType()),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("partition_date", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source_keys", T.ArrayType(T.StringType())),
    T.StructField("input_rows", T.LongType()),
    T.StructField("quality_report_key", T.StringType()),
    T.StructField("curated_keys", T.ArrayType(T.StringType())),
    T.StructField("summary_keys", T.ArrayType(T.StringType())),
    T.StructField("thresholds", T.StructType([
        T.StructField("low_to_medium", T.DoubleType()),
        T.StructField("medium_to_high", T.DoubleType()),
        T.StructField("method", T.StringType()),
    ])),
    T.StructField("spark_version", T.StringType()),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
])
