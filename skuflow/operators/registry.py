"""K1: adapter registry - source type -> adapter (version, DataFrame function).

A batch of retained payloads of mixed source types is split by type, each
part goes through its adapter, and the canonical records / errors are
unioned. A source type without an adapter yields a permanent per-job error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.operators import partners

RECORD_COLS = ["job_id", "source_reference", "source_row", "external_sku", "external_location", "observed_at",
               "source_unit", "on_hand_quantity", "reserved_quantity", "units_per_source_unit"]
ERROR_COLS = ["job_id", "code", "message", "source_row", "field_name"]


def _supplier_a(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    recs, errs = partners.parse_supplier_a(payloads.select(F.col("job_id").alias("payload_id"),
                                                           F.col("content").cast("string").alias("value")))
    return (recs.withColumnRenamed("payload_id", "job_id").select(*RECORD_COLS),
            errs.withColumnRenamed("payload_id", "job_id").select(*ERROR_COLS))


def _supplier_b(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    size = ["length"] if "length" in payloads.columns else []
    rows, file_errors = partners.supplier_b_rows(payloads.select(F.col("job_id").alias("file_id"), "content", *size))
    recs, errs = partners.parse_supplier_b(rows)
    errs = file_errors.unionByName(errs)
    return (recs.withColumnRenamed("file_id", "job_id").select(*RECORD_COLS),
            errs.withColumnRenamed("file_id", "job_id").select(*ERROR_COLS))


ADAPTERS = {
    "supplier_a_json": (S.ADAPTER_VERSIONS["supplier_a_json"], _supplier_a),
    "supplier_b_csv": (S.ADAPTER_VERSIONS["supplier_b_csv"], _supplier_b),
}


def adapt(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``payloads``: job_id, source_type, content (binary) and, for file sources, ``length``."""
    records, errors = [], []
    for source_type, (_, fn) in ADAPTERS.items():
        r, e = fn(payloads.where(F.col("source_type") == source_type))
        records.append(r)
        errors.append(e)
    unknown = payloads.where(~F.col("source_type").isin(*ADAPTERS)).select(
        "job_id", F.lit("permanent_import_error").alias("code"),
        F.concat(F.lit("No adapter is registered for source type '"), F.col("source_type"), F.lit("'."))
        .alias("message"),
        F.lit(None).cast("bigint").alias("source_row"), F.lit(None).cast("string").alias("field_name"))
    rec = records[0]
    for r in records[1:]:
        rec = rec.unionByName(r)
    err = unknown
    for e in errors:
        err = err.unionByName(e)
    return rec, err


def adapter_versions(payloads: DataFrame) -> DataFrame:
    """The adapter version recorded per job (NULL when none is registered)."""
    m = F.create_map(*[x for t, (v, _) in ADAPTERS.items() for x in (F.lit(t), F.lit(v))])
    return payloads.select("job_id", "source_type", m[F.col("source_type")].alias("adapter_version"))
