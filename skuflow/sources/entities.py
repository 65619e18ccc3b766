"""Hub entity tables derived from the driver tables.

Jobs and purchase orders come from ``orders``, attempts and order lines from
``lineitem``, operation events from ``events``, analytics runs from
``customer``, products / warehouses / suppliers from ``part`` / ``nation`` /
``supplier``. Orphans and constraint violations are planted by changed
references on the child side and by deterministic rules, so every audit has
something to find and every parent row stays. All times are UTC instants; reports take an explicit as-of instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.sources.tables import read_table
from skuflow.sources.views import _s, rendered, row_key

AS_OF = "2001-06-01 00:00:00"

# Warehouse time zones by region (one invalid name is planted).
REGION_TIMEZONES = ["Africa/Lagos", "America/New_York", "Asia/Tokyo", "Europe/Berlin", "Asia/Dubai"]


def _plus_seconds(ts, seconds) -> F.Column:
    return F.timestamp_add("SECOND", seconds, ts)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = _plus_seconds(F.col("o_orderdate").cast("timestamp"), k % 86400)
    status = (F.when(F.col("o_orderpriority") == "1-URGENT", "failed")
              .when(F.col("o_orderpriority") == "2-HIGH", "completed")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "completed_with_errors")
              .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "queued")
              .otherwise("processing"))
    df = o.select(
        F.concat(F.lit("JOB-"), _s(k)).alias("job_id"),
        k.alias("job_key"),
        F.concat(F.lit("SUP-"), _s(k % 100)).alias("supplier_id"),
        F.when(k % 2 == 0, F.lit("supplier_a_json")).otherwise(F.lit("supplier_b_csv")).alias("source_type"),
        status.alias("status"),
        created.alias("created_at"),
        F.concat(F.lit("idem-"), _s(k % 5000)).alias("idempotency_key"),
        F.sha2(F.col("o_orderstatus"), 256).alias("content_sha256"),
        (k % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("bigint")).alias("payload_size"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(_plus_seconds(created, (k % 7) * 86400)).alias("next_retry_at"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(_plus_seconds(created, k % 90)).alias("dispatched_at"),
        F.when(status == "processing", _plus_seconds(created, F.lit(300))).alias("lease_expires_at"),
        F.when((k % 5 == 0) & (k % 15 != 0), F.concat(F.lit("JOB-"), _s(k - 5))).alias("replay_of_job_id"),
        F.when(k % 9 == 0, F.concat(F.lit("bad id "), _s(k))).otherwise(F.concat(F.lit("corr-"), _s(k)))
        .alias("correlation_id"),
        (k % 50).cast("int").alias("accepted_records"),
        (F.col("o_custkey") % 5).cast("int").alias("rejected_records"),
        F.when(status.isin("completed", "completed_with_errors", "failed"), _plus_seconds(created, F.lit(3600)))
        .alias("completed_at"),
    )
    return df


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import attempts, one per line item of the job's order (at most seven per
    order), in line order."""
    li = read_table(spark, sf_dir, "lineitem")
    etype = (F.when(F.col("l_returnflag") == "R", F.lit("TimeoutError"))
             .when(F.col("l_returnflag") == "A", F.lit("OperationalError"))
             .when(F.col("l_linestatus") == "O", F.lit("PermanentImportError")))
    return li.select(
        F.concat(F.lit("JOB-"), _s("l_orderkey")).alias("job_id"),
        "l_linenumber",
        row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        .alias("attempt_key"),
        etype.alias("error_type"),
        F.col("l_shipdate").cast("timestamp").alias("started_at"),
    )


def operation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("event_seq"),
        F.concat(F.lit("OPE-"), _s("event_id")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.concat(F.lit("JOB-"), _s(F.col("event_id") % 15000)).alias("job_id"),
        F.col("event_type").alias("component"),
        F.when(F.col("value") > 50, F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.col("props").alias("details"),
    )


def analytics_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("RUN-"), _s(k)).alias("run_id"),
        F.when(k % 2 == 0, F.lit("inventory_reconciliation")).otherwise(F.lit("stockout_risk")).alias("run_type"),
        F.when(k % 2 == 1, F.lit("numpy")).when(k % 4 == 0, F.lit("pandas")).otherwise(F.lit("polars"))
        .alias("engine"),
        (k % 1000 + 1).cast("int").alias("input_rows"),
        F.abs(F.col("c_acctbal")).cast(S.QTY).alias("duration_ms"),
        _plus_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp"), k * 60).alias("created_at"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("PRD-"), _s("p_partkey")).alias("product_id"),
                    F.concat(F.lit("SKU-"), _s("p_partkey")).alias("sku"),
                    F.col("p_name").alias("name"))


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    tz = F.element_at(F.array(*[F.lit(z) for z in REGION_TIMEZONES]), (F.col("n_regionkey") + 1).cast("int"))
    return n.select(
        F.concat(F.lit("WH-"), _s("n_nationkey")).alias("warehouse_id"),
        F.concat(F.lit("wh-"), F.lower("n_name")).alias("code"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") == 13, F.lit("Mars/Olympus")).otherwise(tz).alias("timezone"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("SUP-"), _s("s_suppkey")).alias("supplier_id"),
        F.concat(F.lit(" sup_"), _s("s_suppkey"), F.lit(" ")).alias("code"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    st = (F.when(F.col("o_orderstatus") == "F", "received").when(F.col("o_orderstatus") == "P", "partially_received")
          .otherwise("submitted"))
    return o.select(
        F.concat(F.lit("PO-"), _s("o_orderkey")).alias("order_id"),
        F.concat(F.lit("SUP-"), _s(F.col("o_custkey") % 100)).alias("supplier_id"),
        F.concat(F.lit("REF-"), _s("o_orderkey")).alias("reference"),
        st.alias("status"),
    )


def order_lines(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Requested order lines in input order (``input_pos``). ``by``: see ``rendered``."""
    return rendered(read_table(spark, sf_dir, "lineitem"), {
        "order_id": F.concat(F.lit("PO-"), _s("l_orderkey")),
        "product_id": F.concat(F.when(F.col("l_partkey") % 10 == 0, "PRD-GONE-").otherwise("PRD-"), _s("l_partkey")),
        "input_pos": F.struct("l_linenumber", row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                      "l_extendedprice").alias("k")),
        "ordered_quantity": F.col("l_quantity").cast(S.QTY),
        "received_quantity": F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0.0)).cast(S.QTY),
    }, by)


def order_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shipment per purchase order; every 13th carries another supplier."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sup = F.when(k % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")) % 100
    return o.select(
        F.concat(F.lit("SHIP-"), _s(k)).alias("shipment_id"),
        F.concat(F.lit("PO-"), _s(k)).alias("order_id"),
        F.concat(F.lit("SUP-"), _s(sup)).alias("supplier_id"),
        F.concat(F.lit("T-"), _s(k % 14900)).alias("tracking_reference"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline run manifests: one run per ship date, a second run on even days;
    curated keys list the warehouse partitions written that day (bounded by the
    number of warehouses). Runs on days divisible by 7 failed."""
    li = read_table(spark, sf_dir, "lineitem")
    per_day = li.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("WH-"), _s(F.col("l_suppkey") % 25)))).alias("_wh"),
        F.count(F.lit(1)).alias("input_rows"),
    )
    runs = per_day.select("*", F.explode(F.when(F.dayofmonth("d") % 2 == 0, F.array(F.lit(1), F.lit(2)))
                                         .otherwise(F.array(F.lit(1)))).alias("run"))
    date_s = F.date_format("d", "yyyy-MM-dd")
    run_id = F.concat(F.lit("run-"), _s("run"))
    failed = F.dayofmonth("d") % 7 == 0
    curated = F.transform("_wh", lambda w: F.concat(
        F.lit("curated/inventory-risk/event_date="), date_s, F.lit("/run_id="), run_id,
        F.lit("/warehouse_code="), w, F.lit("/part-00000.parquet")))
    return runs.select(
        F.concat(F.lit("manifests/inventory-risk/event_date="), date_s, F.lit("/run_id="), run_id,
                 F.lit(".json")).alias("manifest_key"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        date_s.alias("partition_date"), run_id.alias("run_id"),
        _plus_seconds(F.col("d").cast("timestamp"), F.col("run") * 3600).alias("created_at"),
        "input_rows",
        F.when(failed, F.array().cast("array<string>")).otherwise(curated).alias("curated_keys"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.array(F.concat(
            F.lit("curated/inventory-risk-summary/event_date="), date_s, F.lit("/run_id="), run_id,
            F.lit("/part-00000.parquet")))).alias("summary_keys"),
    )


def shipment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier events stored for shipments (shipment of the order with the event's number)."""
    ev = read_table(spark, sf_dir, "events")
    etype = F.lit("returned")
    for source, target in (("signup", "picked_up"), ("click", "in_transit"), ("view", "delayed"), ("purchase", "delivered")):
        etype = F.when(F.col("event_type") == source, target).otherwise(etype)
    return ev.select(
        F.concat(F.lit("SHIP-"), _s("event_id")).alias("shipment_id"),
        F.concat(F.lit("C-EVT-"), _s("user_id")).alias("external_event_id"), etype.alias("event_type"),
        F.when(F.col("event_type") == "view", F.lit("WEATHER")).alias("reason_code"),
    )


def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row errors of import jobs, one per returned line of the job's order."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select(
        F.concat(F.lit("JOB-"), _s("l_orderkey")).alias("job_id"), F.lit("invalid_csv_field").alias("error_code"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit("case_count")).alias("field_name"),
        F.concat(F.lit("Input should be greater than 0, not "), _s("l_linenumber")).alias("message"),
    )


def reconciliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reconciliation rows: a run per supplier, a record per part."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("RUN-"), _s("l_suppkey")).alias("run_id"), F.col("l_partkey").alias("record_index"),
        F.concat(F.lit("SUP-"), _s("l_suppkey")).alias("supplier_code"),
        F.concat(F.lit("SKU-"), _s("l_partkey")).alias("product_sku"),
        F.concat(F.lit("WH-"), _s(F.col("l_suppkey") % 25)).alias("warehouse_code"),
    )


def job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that a job accepted: the fulfilled lines of its order."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F")
    return li.select(F.concat(F.lit("JOB-"), _s("l_orderkey")).alias("job_id"), F.col("l_linenumber").alias("source_row"),
                     F.concat(F.lit("PRD-"), _s("l_partkey")).alias("product_id"),
                     F.col("l_quantity").cast("bigint").alias("on_hand"))
