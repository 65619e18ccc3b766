"""Scalar-function queries (C12, C13, C16-C19) and the scalar battery."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions import scalars as X
from skuflow.plans.catalog import register
from skuflow.sources import entities as E
from skuflow.sources.tables import read_table


@register("normalize_code", r"""
SELECT supplier_id, upper(trim(code)) AS normalized_code,
       length(trim(code)) BETWEEN 2 AND 100 AND regexp_full_match(trim(code), '[A-Za-z0-9][A-Za-z0-9_-]*')
         AS code_valid,
       trim(name) AS normalized_name, length(trim(name)) BETWEEN 1 AND 200 AS name_valid
FROM e_suppliers
""", ["e_suppliers"])
def q_normalize_code(spark, sf):
    """Codes stripped and upper-cased, 2..100 chars, restricted alphabet."""
    s = E.suppliers(spark, sf)
    return s.select("supplier_id", X.normalize_code("code").alias("normalized_code"),
                    X.code_valid("code").alias("code_valid"), F.trim("name").alias("normalized_name"),
                    X.name_valid("name").alias("name_valid"))


@register("utc_normalize", """
SELECT event_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at_utc FROM e_op_events
""", ["e_op_events"])
def q_utc_normalize(spark, sf):
    """Instants rendered as ISO-8601 UTC with a Z suffix."""
    return E.operation_events(spark, sf).select("event_id", X.utc_iso("occurred_at").alias("occurred_at_utc"))


@register("safe_run_id", """
SELECT job_id, substring(regexp_replace(correlation_id, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 180) AS safe_run_id
FROM e_jobs
""", ["e_jobs"])
def q_safe_run_id(spark, sf):
    """Unsafe characters replaced by '_', cut to 180."""
    return E.jobs(spark, sf).select("job_id", X.safe_run_id("correlation_id").alias("safe_run_id"))


@register("partition_paths", """
SELECT manifest_key,
       concat('raw/history/inventory/event_date=', partition_date, '/') AS source_prefix,
       concat('quality/inventory/event_date=', partition_date, '/run_id=', run_id, '.json') AS quality_report_key,
       concat('manifests/inventory-risk/event_date=', partition_date, '/run_id=', run_id, '.json') AS manifest_path,
       concat('curated/inventory-risk/event_date=', partition_date, '/run_id=', run_id) AS curated_prefix,
       concat('curated/inventory-risk-summary/event_date=', partition_date, '/run_id=', run_id) AS summary_prefix
FROM e_manifests
""", ["e_manifests"])
def q_partition_paths(spark, sf):
    """C17: source, quality, manifest, curated and summary keys per run."""
    m = E.manifests(spark, sf).withColumn("_d", F.to_date("partition_date"))
    return m.select(
        "manifest_key", X.source_prefix("_d").alias("source_prefix"),
        X.quality_key("_d", "run_id").alias("quality_report_key"),
        X.manifest_key("_d", "run_id").alias("manifest_path"),
        X.curated_prefix("_d", "run_id").alias("curated_prefix"),
        X.curated_prefix("_d", "run_id", summary=True).alias("summary_prefix"))


@register("idempotency_key_valid", r"""
SELECT job_id, idempotency_key,
       length(idempotency_key) BETWEEN 8 AND 128
       AND regexp_full_match(idempotency_key, '[A-Za-z0-9][A-Za-z0-9._:-]*') AS key_valid
FROM e_jobs
""", ["e_jobs"])
def q_idempotency_key_valid(spark, sf):
    """8..128 chars from a restricted alphabet."""
    return E.jobs(spark, sf).select("job_id", "idempotency_key",
                                    X.idempotency_key_valid("idempotency_key").alias("key_valid"))


@register("correlation_id_safe", r"""
SELECT job_id, regexp_full_match(correlation_id, '[A-Za-z0-9._:-]{1,128}') AS correlation_safe,
       CASE WHEN regexp_full_match(correlation_id, '[A-Za-z0-9._:-]{1,128}') THEN correlation_id
            ELSE sha256(job_id) END AS effective_correlation_id
FROM e_jobs
""", ["e_jobs"])
def q_correlation_id_safe(spark, sf):
    """Unsafe correlation ids replaced (deterministically, by a hash of the row key)."""
    j = E.jobs(spark, sf)
    safe = X.correlation_id_safe("correlation_id")
    return j.select("job_id", safe.alias("correlation_safe"),
                    F.when(safe, F.col("correlation_id")).otherwise(F.sha2("job_id", 256))
                    .alias("effective_correlation_id"))


@register("scalar_functions_battery", r"""
SELECT l_orderkey, l_linenumber, l_partkey,
       upper(trim(concat('  sku-', l_partkey, ' '))) AS s_upper_trim,
       lower(l_returnflag) AS s_lower,
       regexp_matches(l_returnflag || l_linestatus, '^[AR]F$') AS s_rlike,
       regexp_replace(concat('a b#', l_partkey), '[^A-Za-z0-9_.-]', '_', 'g') AS s_regexp_replace,
       substring(concat('SUP-', l_suppkey), 1, 5) AS s_substring,
       printf('%07d', l_partkey) AS s_zero_pad,
       ends_with(concat('f', l_partkey), '7') AS s_endswith,
       starts_with(concat('k', l_partkey), 'k1') AS s_startswith,
       concat_ws('/', 'raw', l_returnflag, l_linestatus) AS s_concat_ws,
       greatest(l_quantity - 25.0, 0.0) AS m_greatest,
       least(l_quantity, 10.0) AS m_least,
       abs(l_quantity - 25.0) AS m_abs,
       round(sqrt(l_quantity), 9) AS m_sqrt,
       pow(2.0, l_linenumber) AS m_pow,
       CAST(floor(l_extendedprice / 7.0) AS BIGINT) AS m_floor,
       round_even(l_quantity / 2.0, 0) AS m_rint,
       ((l_orderkey - 7) % 5 + 5) % 5 AS m_pmod,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS m_round,
       strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS d_date_format,
       strftime(l_shipdate + to_seconds(l_linenumber * 3600), '%Y-%m-%dT%H:%M:%SZ') AS d_add_seconds,
       CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 9) END AS c_try_divide,
       nullif(l_linenumber, 1) AS c_nullif,
       coalesce(nullif(l_returnflag, 'N'), 'none') AS c_coalesce,
       sha256(concat(l_orderkey, '-', l_linenumber)) AS h_sha256,
       substring(sha256(concat(l_orderkey, '-', l_linenumber)), 1, 12) AS h_prefix
FROM lineitem
""")
def q_scalar_functions_battery(spark, sf):
    """The scalar function families of the reference, on every line item."""
    li = read_table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.upper(F.trim(F.concat(F.lit("  sku-"), s("l_partkey"), F.lit(" ")))).alias("s_upper_trim"),
        F.lower("l_returnflag").alias("s_lower"),
        F.concat("l_returnflag", "l_linestatus").rlike("^[AR]F$").alias("s_rlike"),
        F.regexp_replace(F.concat(F.lit("a b#"), s("l_partkey")), "[^A-Za-z0-9_.-]", "_").alias("s_regexp_replace"),
        F.substring(F.concat(F.lit("SUP-"), s("l_suppkey")), 1, 5).alias("s_substring"),
        F.format_string("%07d", "l_partkey").alias("s_zero_pad"),
        F.concat(F.lit("f"), s("l_partkey")).endswith("7").alias("s_endswith"),
        F.concat(F.lit("k"), s("l_partkey")).startswith("k1").alias("s_startswith"),
        F.concat_ws("/", F.lit("raw"), "l_returnflag", "l_linestatus").alias("s_concat_ws"),
        F.greatest(F.col("l_quantity") - 25.0, F.lit(0.0)).alias("m_greatest"),
        F.least("l_quantity", F.lit(10.0)).alias("m_least"),
        F.abs(F.col("l_quantity") - 25.0).alias("m_abs"),
        F.round(F.sqrt("l_quantity"), 9).alias("m_sqrt"),
        F.pow(F.lit(2.0), "l_linenumber").alias("m_pow"),
        F.floor(F.col("l_extendedprice") / 7.0).cast("bigint").alias("m_floor"),
        F.rint(F.col("l_quantity") / 2.0).alias("m_rint"),
        F.pmod(F.col("l_orderkey") - 7, F.lit(5)).alias("m_pmod"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(18,2)"))
        .cast("decimal(18,2)").alias("m_round"),
        F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd").alias("d_date_format"),
        X.utc_iso(F.timestamp_add("SECOND", F.col("l_linenumber") * 3600, F.col("l_shipdate").cast("timestamp")))
        .alias("d_add_seconds"),
        F.round(F.try_divide("l_tax", F.when(F.col("l_discount") > 0, F.col("l_discount"))), 9).alias("c_try_divide"),
        F.nullif("l_linenumber", F.lit(1)).alias("c_nullif"),
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")).alias("c_coalesce"),
        F.sha2(F.concat(s("l_orderkey"), F.lit("-"), s("l_linenumber")), 256).alias("h_sha256"),
        F.substring(F.sha2(F.concat(s("l_orderkey"), F.lit("-"), s("l_linenumber")), 256), 1, 12).alias("h_prefix"),
    )


@register("valid_timezone", """
SELECT warehouse_id, timezone, timezone IS NOT NULL AND timezone IN (SELECT name FROM pg_timezone_names()) AS timezone_valid
FROM e_warehouses
""", ["e_warehouses"])
def q_valid_timezone(spark, sf):
    """Warehouse time zones checked against the IANA names."""
    return X.with_timezone_valid(E.warehouses(spark, sf)).select("warehouse_id", "timezone", "timezone_valid")
