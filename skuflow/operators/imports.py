"""Applying canonical partner records: mapping lookups, duplicate rules, reject
precedence, unit conversion, snapshots, positions, job accounting.

The reference validates one record at a time with four or five database
queries per record. Here a whole batch of jobs is one plan:

* mapping lookups are left joins on supplier and external code (D2, D3) with
  residual unit / factor checks (D13);
* "first occurrence in a file claims the key" (F1) and "an accepted snapshot
  already exists" (D4) concern only the source keys that several records have.
  One partial aggregate finds those; two more over their records give the
  claims, which are joined back: a hot key is combined map-side and its join
  is split by AQE's skew handling instead of being sorted in one window task,
  and few repeated keys are broadcast, so the records are not shuffled for them;
* the first failing rule wins (F2) in one ``CASE`` chain;
* where only accepted records are wanted (snapshots, positions, counts), two
  aggregates find them where their product mapping met them and nothing is
  joined back (``accepted``);
* positions keep the last accepted write in source order (F3) via ``max_by``.

Jobs are ordered by ``job_seq`` (arrival order of jobs); within a job records
are ordered by ``source_row``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions import scalars as X

SOURCE_KEY = ["supplier_id", "source_reference", "external_sku", "external_location"]


def _active_products(product_map: DataFrame) -> DataFrame:
    return product_map.where("active").select(
        "supplier_id", "external_sku", "product_id",
        F.col("source_unit").alias("_map_unit"),
        F.col("units_per_source_unit").alias("_map_factor"),
        F.col("version").alias("product_mapping_version"),
    )


def _active_warehouses(warehouse_map: DataFrame) -> DataFrame:
    return warehouse_map.where("active").select(
        "supplier_id", "external_location", "warehouse_id", F.col("version").alias("warehouse_mapping_version"),
    )


def _unit_differs() -> Column:
    return F.col("_map_unit") != F.col("source_unit")


def _factor_differs() -> Column:
    return F.col("units_per_source_unit").isNotNull() & (F.col("units_per_source_unit") != F.col("_map_factor"))


def mapping_flags(records: DataFrame, product_map: DataFrame, warehouse_map: DataFrame) -> DataFrame:
    """Attach active mappings and the first failing mapping rule.

    ``product_map``: supplier_id, external_sku, product_id, source_unit, units_per_source_unit, version, active
    ``warehouse_map``: supplier_id, external_location, warehouse_id, version, active
    A mapping belongs to its supplier: two suppliers may use the same SKU or
    location for different things.
    Mapping tables are dimensions: AQE broadcasts them when their runtime size
    is under the broadcast threshold and shuffles them otherwise.
    """
    pm, wm = _active_products(product_map), _active_warehouses(warehouse_map)
    joined = (records.join(pm, ["supplier_id", "external_sku"], "left")
              .join(wm, ["supplier_id", "external_location"], "left"))
    code = (
        F.when(F.col("product_id").isNull(), F.lit("product_mapping_not_found"))
        .when(F.col("warehouse_id").isNull(), F.lit("warehouse_mapping_not_found"))
        .when(_unit_differs(), F.lit("source_unit_mismatch"))
        .when(_factor_differs(), F.lit("unit_conversion_mismatch"))
    )
    field = (
        F.when(F.col("product_id").isNull(), F.lit("external_sku"))
        .when(F.col("warehouse_id").isNull(), F.lit("external_location"))
        .when(_unit_differs(), F.lit("source_unit"))
        .when(_factor_differs(), F.lit("units_per_source_unit"))
    )
    return joined.withColumn("_map_code", code).withColumn("_map_field", field)


def claims(records: DataFrame, product_map: DataFrame, warehouse_map: DataFrame,
           once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``(source key, job_seq, _first_row, _accepted_job)`` for the source keys
    that more than one record has: the first row of the key in the job, and the
    first job that accepts it. Within a job the accepted candidate is the first
    occurrence, and it is accepted iff its mapping checks pass and no earlier
    job accepted the key."""
    repeated = once(records.dropna(subset=SOURCE_KEY).groupBy(*SOURCE_KEY).agg(F.count(F.lit(1)).alias("_n"))
                    .where("_n > 1").select(*SOURCE_KEY))
    some = mapping_flags(records.join(repeated, SOURCE_KEY, "left_semi"), product_map, warehouse_map)
    per_job = some.groupBy(*SOURCE_KEY, "job_seq").agg(
        F.min("source_row").alias("_first_row"),
        F.min_by(F.col("_map_code").isNull(), F.col("source_row")).alias("_first_ok"),
    )
    per_key = per_job.groupBy(*SOURCE_KEY).agg(
        F.min(F.when(F.col("_first_ok"), F.col("job_seq"))).alias("_accepted_job")
    )
    return once(per_job.drop("_first_ok").join(per_key, SOURCE_KEY))


def duplicate_flags(flagged: DataFrame, claimed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """F1 + D4. ``claimed``: see ``claims``; ``stored``: snapshots accepted
    before this batch (any table with the source key's columns). Records
    without a whole key, or without a job, get no verdict.

    * in-file duplicate: an earlier ``source_row`` of the same job has the key
      (the first occurrence claims the key even when it is rejected later);
    * already imported: an earlier job accepted a record with the key.
    """
    j = flagged.dropna(subset=[*SOURCE_KEY, "job_seq"]).join(claimed, [*SOURCE_KEY, "job_seq"], "left")
    if stored is not None:
        before = stored.select(*SOURCE_KEY).distinct().withColumn("_stored", F.lit(True))
        j = j.join(before, SOURCE_KEY, "left")
    else:
        j = j.withColumn("_stored", F.lit(False))
    # A key of one record is claimed by that one.
    return (
        j.withColumn("duplicate_in_file", F.col("source_row") != F.coalesce("_first_row", "source_row"))
        .withColumn("already_imported", F.coalesce("_stored", F.lit(False))
                    | F.coalesce(F.col("_accepted_job") < F.col("job_seq"), F.lit(False)))
        .drop("_first_row", "_accepted_job", "_stored")
    )


def verdicts(records: DataFrame, product_map: DataFrame, warehouse_map: DataFrame,
             stored: DataFrame | None = None, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """one verdict per record; first failing rule wins:
    duplicate -> product map -> warehouse map -> unit -> factor.

    ``once`` may keep the repeated keys and their claims: where they are few,
    the optimizer then knows it before it plans to join the records with them.
    """
    claimed = claims(records, product_map, warehouse_map, once)
    d = duplicate_flags(mapping_flags(records, product_map, warehouse_map), claimed, stored)
    dup = F.col("duplicate_in_file") | F.col("already_imported")
    return (
        d.withColumn("error_code", F.when(dup, F.lit("duplicate_source_record")).otherwise(F.col("_map_code")))
        .withColumn("field_name", F.when(dup, F.lit(None).cast("string")).otherwise(F.col("_map_field")))
        .withColumn("accepted", F.col("error_code").isNull())
        .drop("_map_code", "_map_field")
    )


def accepted(records: DataFrame, product_map: DataFrame, warehouse_map: DataFrame,
             stored: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The accepted records alone, as ``verdicts(...).where("accepted")`` gives them, without joins to themselves.

    At most one record of a source key is accepted: the first of its job, in the first job in which that
    one's mappings hold. Records meet their product mapping by supplier and SKU, which the source key holds, so the
    two aggregates that follow (the first record per key and job, the first job per key) find their rows together
    and shuffle nothing; records without a mapping go no further. Whether a location is mapped is one answer for
    the whole key: it is asked last, for the one record that is left.
    ``columns``: the ones wanted besides the source key and ``job_seq``, if not all; no others are shuffled.
    """
    read = records.columns if columns is None else [*columns, "source_row", "source_unit", "units_per_source_unit"]
    payload = [c for c in records.columns if c in read and c not in (*SOURCE_KEY, "job_seq")]
    pm = _active_products(product_map)
    mapped = [c for c in pm.columns if c not in SOURCE_KEY]
    # The aggregates get made columns: what stands inside them is interpreted row by row.
    rows = records.select(*SOURCE_KEY, "job_seq", "source_row", F.struct(*payload).alias("_p"))
    joined = rows.join(pm, ["supplier_id", "external_sku"])
    first = joined.groupBy(*SOURCE_KEY, "job_seq", *mapped).agg(F.min_by("_p", "source_row").alias("_r"))
    bad = F.coalesce(_unit_differs(), F.lit(False)) | F.coalesce(_factor_differs(), F.lit(False))
    good = first.select(*SOURCE_KEY, "job_seq", *mapped, "_r.*").where(F.col("product_id").isNotNull() & ~bad)
    kept = [c for c in good.columns if c not in SOURCE_KEY and (columns is None or c in ("job_seq", *columns))]
    one = good.select(*SOURCE_KEY, "job_seq", F.struct(*kept).alias("_p")).groupBy(*SOURCE_KEY).agg(
        F.min_by("_p", "job_seq").alias("_r"))
    place = _active_warehouses(warehouse_map).where("warehouse_id IS NOT NULL").groupBy("supplier_id", "external_location").agg(
        F.min(F.struct("warehouse_id", "warehouse_mapping_version")).alias("_w"))
    located = [c for c in ("warehouse_id", "warehouse_mapping_version") if columns is None or c in columns]
    # A key without a job has no first one, and shows nothing but itself.
    one = one.join(place, ["supplier_id", "external_location"]).select(
        *SOURCE_KEY, "_r.*", *[F.when(F.col("_r").isNotNull(), F.col("_w")[c]).alias(c) for c in located])
    if stored is not None:
        one = one.join(stored.select(*SOURCE_KEY).distinct(), SOURCE_KEY, "left_anti")
    return one.withColumn("accepted", F.lit(True))


def snapshots(v: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Accepted records as append-only snapshots in canonical units (C6), or ``columns`` of them."""
    made = {
        "on_hand_quantity": X.unit_conversion("on_hand_quantity", "_map_factor"),
        "reserved_quantity": X.unit_conversion("reserved_quantity", "_map_factor"),
        "units_per_source_unit": F.col("_map_factor").cast(S.QTY),
    }
    shown = ["import_job_id", "job_seq", "supplier_id", "product_id", "warehouse_id",
             "source_reference", "external_sku", "external_location", "observed_at", "source_row",
             "source_unit", *made, "product_mapping_version", "warehouse_mapping_version"]
    return v.where("accepted").select(*[made.get(c, F.col(c)).alias(c) for c in shown if columns is None or c in columns])


def rejects(v: DataFrame) -> DataFrame:
    """Apply-time errors (one per rejected record)."""
    return v.where(~F.col("accepted")).select(
        "import_job_id", "source_row", F.col("error_code").alias("code"), "field_name",
    )


def positions(snaps: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """last accepted write per (warehouse, product) in source order wins;
    a new position starts at version 1 and every later write adds one.
    No observed_at guard: an older snapshot applied later overwrites."""
    latest = snaps.groupBy("warehouse_id", "product_id").agg(
        F.max_by(F.struct("on_hand_quantity", "reserved_quantity"), F.struct("job_seq", "source_row")).alias("_q"),
        F.count(F.lit(1)).alias("_writes"),
    )
    latest = latest.select(
        "warehouse_id", "product_id",
        F.col("_q.on_hand_quantity").alias("on_hand_quantity"),
        F.col("_q.reserved_quantity").alias("reserved_quantity"), "_writes",
    )
    if current is None:
        return latest.withColumn("version", F.col("_writes").cast("int")).drop("_writes")
    cur = current.select("warehouse_id", "product_id",
                         F.col("on_hand_quantity").alias("_cur_on"),
                         F.col("reserved_quantity").alias("_cur_res"), F.col("version").alias("_cur_v"))
    m = cur.join(latest, ["warehouse_id", "product_id"], "full_outer")
    return m.select(
        "warehouse_id", "product_id",
        F.coalesce("on_hand_quantity", "_cur_on").alias("on_hand_quantity"),
        F.coalesce("reserved_quantity", "_cur_res").alias("reserved_quantity"),
        (F.coalesce(F.col("_cur_v"), F.lit(0)) + F.coalesce(F.col("_writes"), F.lit(0))).cast("int").alias("version"),
    )


def accounting(v: DataFrame, adapter_errors: DataFrame | None = None) -> DataFrame:
    """Accepted, rejected (= distinct rejected source rows + 1 when any
    file-level error exists), total, and the completion status per job."""
    apply_side = v.select(
        "import_job_id", F.col("accepted"),
        F.when(~F.col("accepted"), F.col("source_row")).alias("_rej_row"),
        F.lit(False).alias("_file_error"),
    )
    if adapter_errors is not None:
        adapter_side = adapter_errors.select(
            "import_job_id", F.lit(False).alias("accepted"),
            F.col("source_row").cast("bigint").alias("_rej_row"),
            F.col("source_row").isNull().alias("_file_error"),
        )
        apply_side = apply_side.unionByName(adapter_side)
    acc = apply_side.groupBy("import_job_id").agg(
        F.count_if("accepted").alias("accepted_records"),
        (F.count_distinct("_rej_row") + F.max(F.col("_file_error").cast("int"))).alias("rejected_records"),
    )
    return acc.withColumn("total_records", F.col("accepted_records") + F.col("rejected_records")).withColumn(
        "status",
        F.when(F.col("rejected_records") == 0, F.lit("completed")).otherwise(F.lit("completed_with_errors")),
    )


def all_errors(adapter_errors: DataFrame, apply_errors: DataFrame) -> DataFrame:
    """H4: adapter (parse) errors union apply-time errors."""
    cols = ["import_job_id", "source_row", "code", "field_name"]
    return adapter_errors.select(*cols).unionByName(apply_errors.select(*cols))


def rejected_row_set(errors: DataFrame) -> DataFrame:
    """H5: distinct rejected source rows per job."""
    return errors.where(F.col("source_row").isNotNull()).select("import_job_id", "source_row").distinct()


def resolve_supplier(records: DataFrame, suppliers: DataFrame, code_col: str = "supplier_code") -> tuple[DataFrame, DataFrame]:
    """(records with a known supplier, records whose code is unknown)."""
    known = records.join(suppliers.select(F.col("code").alias(code_col), F.col("supplier_id")), code_col, "inner")
    unknown = records.join(suppliers.select(F.col("code").alias(code_col)), code_col, "left_anti")
    return known, unknown
