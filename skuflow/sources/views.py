"""Domain views derived from the driver tables.

The driver supplies a TPC-H-like star; the operators here work on inventory
history, partner feeds, mappings, shipments and job logs. Each view below is a
pure projection / aggregation of a driver table, so its size grows with the
table and every plan stays a Spark plan. The same derivations are written
independently in DuckDB SQL for the oracle (``skuflow.plans.oracle_views``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions.scalars import md5_uint
from skuflow.sources.tables import read_table


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _history_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").cast("date").alias("event_date"),
        F.concat(F.lit("SUP-"), _s("l_suppkey")).alias("supplier_code"),
        F.concat(F.lit("SKU-"), _s("l_partkey")).alias("product_sku"),
        F.concat(F.lit("WH-"), _s(F.col("l_suppkey") % 25)).alias("warehouse_code"),
        (F.col("l_quantity") * 10).alias("on_hand_quantity"),
        F.floor(F.col("l_quantity") * 50 * F.col("l_tax")).cast("double").alias("reserved_quantity"),
        (F.col("l_linenumber") * 15).cast("double").alias("inbound_quantity"),
        (1 + (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11) % 600).cast("double").alias("forecast_quantity"),
        ((F.col("l_orderkey") * 53 + F.col("l_suppkey") * 7) % 600).cast("double").alias("actual_demand_quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                 "l_suppkey").alias("_ord"),
    )


def v_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily inventory history rows (one per line item)."""
    return _history_with_order(spark, sf_dir).drop("_ord")


def v_inv_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with one row per key: the first by a total order of the source row.

    ``min_by`` is a partial/final aggregate, so a hot key is combined map-side
    instead of being sorted whole inside one window partition.
    """
    h = _history_with_order(spark, sf_dir)
    kept = h.groupBy(*S.KEY_COLUMNS).agg(
        F.min_by(F.struct(*S.QUANTITY_COLUMNS), F.col("_ord")).alias("_q")
    )
    return kept.select(*S.KEY_COLUMNS, *[F.col(f"_q.{c}").alias(c) for c in S.QUANTITY_COLUMNS])


def v_inv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History as a partner CSV delivers it: planted blank / NULL keys and
    NULL / negative quantities, for the quality gate (C8, E1)."""
    h = _history_with_order(spark, sf_dir).select(
        "*", F.col("_ord.l_orderkey").alias("_ok"), F.col("_ord.l_partkey").alias("_pk"),
        F.col("_ord.l_linenumber").alias("_ln"),
        F.col("_ord.l_suppkey").alias("_sk"),
    )
    return h.select(
        "event_date",
        F.when(F.col("_ok") % 211 == 0, F.lit("  ")).otherwise(F.col("supplier_code")).alias("supplier_code"),
        F.when(F.col("_ok") % 389 == 0, F.lit(None).cast("string")).otherwise(F.col("product_sku")).alias("product_sku"),
        "warehouse_code",
        F.when(F.col("_pk") % 307 == 0, F.lit(None).cast("double")).otherwise(F.col("on_hand_quantity")).alias("on_hand_quantity"),
        "reserved_quantity",
        F.when((F.col("_sk") % 53 == 0) & (F.col("_ln") == 3), F.lit(-1.0)).otherwise(F.col("inbound_quantity")).alias("inbound_quantity"),
        "forecast_quantity",
        "actual_demand_quantity",
    )


def recon_sides(spark: SparkSession, sf_dir: str, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """Supplier-reported vs hub quantities per (part, supplier) pair.

    hub = summed line quantity; reported = max(hub + delta, 0) with delta drawn
    from the reconciliation delta list by an md5 integer of the pair. The
    record index packs the pair into one BIGINT (no global numbering pass).
    """
    li = read_table(spark, sf_dir, "lineitem")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("_q"))
    deltas = F.array(*[F.lit(d) for d in S.RECONCILIATION_DELTAS])
    pick = md5_uint(F.concat(F.lit(f"{seed}-"), _s("l_partkey"), F.lit("-"), _s("l_suppkey"))) % 10
    base = pairs.select(
        (F.col("l_partkey") * F.lit(4294967296) + F.col("l_suppkey")).alias("record_index"),
        F.concat(F.lit("SUP-"), _s("l_suppkey")).alias("supplier_code"),
        F.concat(F.lit("SKU-"), _s("l_partkey")).alias("product_sku"),
        F.concat(F.lit("WH-"), _s(F.col("l_suppkey") % 25)).alias("warehouse_code"),
        F.floor("_q").cast("bigint").alias("hub_quantity"),
        F.element_at(deltas, (pick + 1).cast("int")).cast("bigint").alias("_delta"),
    )
    supplier = base.select(
        "record_index", "supplier_code", "product_sku", "warehouse_code",
        F.greatest(F.col("hub_quantity") + F.col("_delta"), F.lit(0).cast("bigint")).alias("reported_quantity"),
    )
    hub = base.select("record_index", "product_sku", "warehouse_code", "hub_quantity")
    return supplier, hub


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense row indices 0..n-1 taken from ``orders.o_orderkey``."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))


def _units() -> F.Column:
    return F.array(*[F.lit(u) for u in S.UNIT_OF_MEASURE])


def _row_text(*cols: str) -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def row_key(*cols: str) -> F.Column:
    """A 60-bit position key of a source row (unique over the driver tables);
    stands in for a partner file's line number without a numbering pass."""
    return md5_uint(_row_text(*cols), 15)


def rendered(df: DataFrame, columns: dict[str, F.Column], by: list[str] | None = None) -> DataFrame:
    """``columns`` made of ``df``. ``by``: those that the rows come partitioned by; the rows of ``df`` meet as they
    are read, and the columns are made behind the shuffle, in as many tasks as it has (rows grow there, so tasks are
    not merged by the size of what was read)."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = df.repartition(tasks, *[columns[c] for c in by]) if by else df
    return met.select(*[c.alias(name) for name, c in columns.items()])


def feed_records(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Canonical partner records: one import job per (supplier, ship year),
    jobs applied in year order. ``by``: see ``rendered``."""
    li = read_table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    own = _own_number("l_partkey", "l_suppkey")
    unit_idx = (own + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)) % 4
    factor = F.when(F.col("l_linenumber") % 2 == 1, F.lit(None)).otherwise(
        F.lit(1) + own % 12 + F.when(F.col("l_linenumber") == 6, 1).otherwise(0))
    return rendered(li, {
        "import_job_id": F.concat(F.lit("JOB-"), _s("l_suppkey"), F.lit("-"), _s(year)),
        "job_seq": year.cast("int"),
        "supplier_id": F.concat(F.lit("SUP-"), _s("l_suppkey")),
        "source_reference": F.concat(F.lit("REF-"), _s(F.col("l_orderkey") % 400)),
        "source_row": row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
        "external_sku": F.concat(F.when(F.col("l_partkey") % 10 == 0, "NEW-").otherwise("EXT-"), _s("l_partkey")),
        "external_location": F.concat(F.when(F.col("l_suppkey") % 25 == 7, "YARD-").otherwise("LOC-"),
                                      _s(F.col("l_suppkey") % 25)),
        "observed_at": F.col("l_shipdate").cast("timestamp"),
        "source_unit": F.element_at(_units(), (unit_idx + 1).cast("int")),
        "on_hand_quantity": F.col("l_quantity").cast(S.QTY),
        "reserved_quantity": (F.col("l_quantity") * F.col("l_discount")).cast(S.QTY),
        "units_per_source_unit": factor.cast(S.QTY),
    }, by)


def _own_number(part: str, supplier: str) -> F.Column:
    """Suppliers count a part in units of their own: equal SKUs differ between suppliers."""
    return F.col(part) + F.col(supplier) % 2


def product_map(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Active / inactive product mappings per (supplier, external SKU): one for
    every part that a supplier delivers. Suppliers share SKUs, with different
    units and factors. ``dealt``: the rows come partitioned by that key."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    key = {"supplier_id": F.concat(F.lit("SUP-"), _s("l_suppkey")), "external_sku": F.concat(F.lit("EXT-"), _s("l_partkey"))}
    if dealt:
        # The key writes the pair: pairs and keys are as many.
        li = rendered(li, key | {c: F.col(c) for c in li.columns}, list(key)).groupBy(*key).agg(
            *[F.any_value(c).alias(c) for c in li.columns])
    else:
        li = li.distinct().withColumns(key)
    own = _own_number("l_partkey", "l_suppkey")
    mix = F.col("l_partkey") * 3 + F.col("l_suppkey")
    return li.select(
        *key,
        F.concat(F.lit("PRD-"), _s("l_partkey")).alias("product_id"),
        F.element_at(_units(), (own % 4 + 1).cast("int")).alias("source_unit"),
        (F.lit(1) + own % 12).cast(S.QTY).alias("units_per_source_unit"),
        (F.lit(1) + mix % 3).cast("int").alias("version"),
        (mix % 7 != 0).alias("active"),
    )


def warehouse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location mappings per (supplier, external location); suppliers share locations."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("SUP-"), _s("s_suppkey")).alias("supplier_id"),
        F.concat(F.lit("LOC-"), _s(F.col("s_suppkey") % 25)).alias("external_location"),
        F.concat(F.lit("WH-"), _s(F.col("s_suppkey") % 25)).alias("warehouse_id"),
        (F.lit(1) + F.col("s_suppkey") % 2).cast("int").alias("version"),
        (F.col("s_suppkey") % 11 != 10).alias("active"),
    )


# ---------------------------------------------------------------------------
# Partner payloads rendered from the driver tables (with planted defects)
# ---------------------------------------------------------------------------
_SB_CANON = ["snapshot_ref", "as_of", "partner_sku", "depot", "case_count", "units_per_case"]
_SB_REORDERED = ["depot", "partner_sku", "snapshot_ref", "as_of", "units_per_case", "case_count", "note"]
_SB_MISSING = ["snapshot_ref", "partner_sku", "case_count", "units_per_case"]
_SB_WIDE = [f"x{i}" for i in range(1, 35)]


def supplier_b_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier B CSV records: one file per supplier, header variants by supplier
    (reordered + extra column, trailing unnamed values, missing headers, 34
    more columns and a blank header in front), data records from line items
    with bad timestamps, blank SKUs, negative counts, zero factors, too many
    decimals, quoted commas, doubled quotes and line breaks."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    variant = (F.when(F.col("s_suppkey") % 17 == 0, F.lit(3)).when(F.col("s_suppkey") % 7 == 0, F.lit(4))
               .otherwise((F.col("s_suppkey") % 3).cast("int")))
    files = sup.select(F.concat(F.lit("B-"), _s("s_suppkey")).alias("file_id"), "s_suppkey",
                       variant.alias("variant"))
    headers = files.select(
        "file_id", F.lit(1).cast("bigint").alias("source_row"),
        F.when(F.col("variant") == 0, F.lit(",".join(_SB_REORDERED)))
        .when(F.col("variant") == 3, F.lit(",".join(_SB_MISSING)))
        .when(F.col("variant") == 4, F.lit(",".join([*_SB_WIDE, "", *_SB_CANON])))
        .otherwise(F.lit(",".join(_SB_CANON))).alias("text"),
        F.lit(True).alias("is_header"),
    )
    li = read_table(spark, sf_dir, "lineitem")
    pk = F.col("l_partkey")
    iso = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    v = {
        "snapshot_ref": F.concat(F.lit("SB-"), _s(F.col("l_orderkey") % 400)),
        "as_of": F.when(pk % 13 == 0, iso)
        .when((pk % 11 == 0) & (F.col("l_linenumber") == 5), F.lit("not-a-time"))
        .otherwise(F.concat(iso, F.lit("-07:00"))),
        "partner_sku": F.when(F.col("l_orderkey") % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("EXT-"), _s(pk))),
        "depot": F.concat(F.lit("LOC-"), _s(F.col("l_suppkey") % 25)),
        "case_count": F.when(pk % 17 == 0, F.lit("-2")).otherwise(F.format_string("%.3f", F.col("l_quantity"))),
        "units_per_case": F.when(pk % 19 == 0, F.lit("0")).when(pk % 23 == 0, F.lit("1.2345"))
        .otherwise(F.format_string("%.3f", (F.lit(1) + pk % 12).cast("double"))),
        "note": F.lit('"not ""final"", \nsee below"'),
    }
    quoted_ref = F.concat(F.lit('"SB ""'), _s(F.col("l_orderkey") % 400), F.lit('"", a"'))
    wide = [F.lit(str(i)) for i in range(len(_SB_WIDE))]
    data = li.join(files, li.l_suppkey == files.s_suppkey).select(
        "file_id",
        row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        .alias("source_row"),
        F.when(F.col("variant") == 0, F.concat_ws(",", *[v[c] for c in _SB_REORDERED]))
        .when(F.col("variant") == 2, F.concat_ws(",", *[v[c] for c in _SB_CANON], F.lit("extra")))
        .when(F.col("variant") == 3, F.concat_ws(",", *[v[c] for c in _SB_MISSING]))
        .when(F.col("variant") == 4, F.concat_ws(",", *wide, F.lit("blank"), quoted_ref, *[v[c] for c in _SB_CANON[1:]]))
        .otherwise(F.concat_ws(",", *[v[c] for c in _SB_CANON])).alias("text"),
        F.lit(False).alias("is_header"),
    )
    return headers.unionByName(data)


def _three_places(value: F.Column) -> F.Column:
    """``format_string("%.3f", value)`` of a double; plain values by a cast, several times faster."""
    return F.when((value > 0) & (value < 1e9), value.cast("decimal(18,3)").cast("string")).otherwise(
        F.format_string("%.3f", value))


def _whole_three_places(value: F.Column) -> F.Column:
    """``format_string("%.3f", value)`` of a whole number as a double; those that a double holds by their digits."""
    return F.when(value.between(-(10**15), 10**15), F.concat(_s(value), F.lit(".000"))).otherwise(
        F.format_string("%.3f", value.cast("double")))


def supplier_a_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier A JSON snapshots: one per order, items = the order's line items
    (at most seven per order by the TPC-H data model), ordered by line number.
    Defects: unknown unit (payload invalid), negative on-hand, missing allocated."""
    # Rows meet by order as they are read; they become text behind the shuffle, in as many tasks as it has.
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull()).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    pk = F.col("l_partkey")
    item = F.struct(
        F.concat(F.lit("EXT-"), _s(pk)).alias("item_number"),
        F.concat(F.lit("LOC-"), _s(F.col("l_suppkey") % 25)).alias("location"),
        F.when(pk % 31 == 0, F.lit("-5.000")).otherwise(_three_places(F.col("l_quantity"))).alias("on_hand"),
        F.when(F.col("l_linenumber") == 2, F.lit(None).cast("string"))
        .otherwise(_whole_three_places(F.floor(F.col("l_quantity") * F.col("l_discount")))).alias("allocated"),
        F.when(pk % 29 == 0, F.lit("BOX")).otherwise(
            F.element_at(_units(), (pk % 4 + 1).cast("int"))).alias("unit"),
    )
    # Hexadecimal digits order rows as their ``row_key``, the number they write, does. The aggregate gets a
    # made column: what stands inside a collect_list is interpreted row by row.
    found = li.select("l_orderkey", F.struct(
        F.col("l_linenumber").alias("_k1"),
        F.substring(F.md5(_row_text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                    "l_extendedprice")), 1, 15).alias("_k2"),
        item.alias("item")).alias("_row"))
    per_order = found.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("_row"))["item"].alias("_items"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    doc = per_order.join(o, per_order.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("SA-"), _s("l_orderkey")).alias("payload_id"),
        F.to_json(F.struct(
            F.concat(F.lit("SA-"), _s("l_orderkey")).alias("snapshot_id"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("captured_at"),
            F.col("_items").alias("items"),
        )).alias("value"),
    )
    return doc


_CARRIER_TYPES = [("signup", "PICKED_UP"), ("click", "IN_TRANSIT"), ("view", "DELAYED"),
                  ("purchase", "DELIVERED"), ("error", "CANCELLED")]


def carrier_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier C JSON events from ``events``: tracking = user + day; every
    13th event is re-sent right after itself; unknown types, naive times and
    (for every 41st user) unknown tracking references are planted.
    ``arrival_seq`` is the arrival order."""
    ev = read_table(spark, sf_dir, "events")
    etype = F.lit("LOST")
    for src, dst in reversed(_CARRIER_TYPES):
        etype = F.when(F.col("event_type") == src, F.lit(dst)).otherwise(etype)
    etype = F.when(F.col("event_id") % 50 == 0, F.lit("LOST")).otherwise(etype)
    ts = F.col("ts").cast("timestamp")
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    etime = (F.when(F.col("event_id") % 10 == 3, F.date_format(ts, fmt))
             .when(F.col("event_id") % 10 == 7,
                   F.concat(F.date_format(ts - F.expr("INTERVAL 7 HOURS"), fmt), F.lit("-07:00")))
             .otherwise(F.concat(F.date_format(ts, fmt), F.lit("Z"))))
    tracking = F.concat(F.when(F.col("user_id") % 41 == 0, "T-LOST-").otherwise("T-"), _s("user_id"), F.lit("-"),
                        F.date_format(ts, "yyyyMMdd"))
    base = ev.select(
        "event_id",
        F.to_json(F.struct(
            F.concat(F.lit("C-EVT-"), _s("event_id")).alias("event_id"),
            tracking.alias("tracking_number"),
            etype.alias("event"),
            etime.alias("event_time"),
            F.when(F.col("event_type") == "view", F.lit("WEATHER")).alias("reason_code"),
        )).alias("value"),
    )
    sent = F.when(F.col("event_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("event_id", "value", F.explode(sent).alias("_again")).select(
        (F.col("event_id") * 2 + F.col("_again")).alias("arrival_seq"), "value")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned shipments, one per (user, day) of ``events``; every 37th user's
    tracking references belong to two suppliers (ambiguous)."""
    ev = read_table(spark, sf_dir, "events")
    days = ev.select("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("d")).distinct()
    key = F.concat(_s("user_id"), F.lit("-"), F.col("d"))
    main = F.struct(F.concat(F.lit("SHP-"), key).alias("shipment_id"),
                    F.concat(F.lit("SUP-"), _s(F.col("user_id") % 7)).alias("supplier_id"))
    extra = F.struct(F.concat(F.lit("SHP-"), key, F.lit("-B")).alias("shipment_id"), F.lit("SUP-X").alias("supplier_id"))
    planned = F.when(F.col("user_id") % 37 == 0, F.array(main, extra)).otherwise(F.array(main))
    return days.select(F.concat(F.lit("T-"), key).alias("tracking_reference"), F.explode(planned).alias("s")).select(
        "s.shipment_id", "tracking_reference", "s.supplier_id")


def mapping_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping upsert log from ``events`` (every non-purchase event is an upsert
    of the user's product and warehouse mappings), in (ts, event_id) order."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    bucket = (F.floor("value") % 3).cast("bigint")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("EXT-U"), _s("user_id")).alias("external_sku"),
        F.concat(F.lit("PRD-"), F.col("event_type")).alias("product_id"),
        F.lit("EACH").alias("source_unit"),
        (F.lit(1) + bucket).cast(S.QTY).alias("units_per_source_unit"),
        F.lit(True).alias("active"),
        F.concat(F.lit("LOC-U"), _s("user_id")).alias("external_location"),
        F.concat(F.lit("WH-"), _s(bucket)).alias("warehouse_id"),
        (F.col("event_type") != "error").alias("warehouse_active"),
    )


def mapped_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots applied over time: each purchase event applies one snapshot
    of the user's SKU at its timestamp."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("applied_at"),
        F.concat(F.lit("EXT-U"), _s("user_id")).alias("external_sku"),
        F.floor("value").cast(S.QTY).alias("source_quantity"),
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request log from ``events``: route = event type, status by event id,
    duration = value / 10 seconds, logged at completion (``ts``)."""
    ev = read_table(spark, sf_dir, "events")
    status = (F.when(F.col("event_id") % 20 == 0, F.lit("500"))
              .when(F.col("event_id") % 20 < 3, F.lit("404")).otherwise(F.lit("200")))
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("completed_at"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("route"), status.alias("status"),
        (F.col("value") / 10).alias("duration_s"),
        F.round(F.col("value") * 100000).cast("bigint").alias("duration_us"),
    )
