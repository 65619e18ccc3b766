"""Partner adapters: raw payloads -> canonical records + row-level rejects.

Supplier B (CSV), supplier A (nested JSON) and carrier C (JSON events).
Validation is expressed as arrays of ``when(bad, struct(error))`` filtered for
NULLs and exploded, so each bad field yields one error row and every rule stays
a native expression. Files are bounded (10 MiB for supplier B, 10 000 items for
supplier A), so per-file array work inside one row is bounded too.
"""

from __future__ import annotations

import csv
import functools
import io
import itertools
import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions import scalars as X

_ROWS_PER_BATCH = 5000
# A comma and the field behind it; a quote opens a quoted field only at its start.
_CSV_FIELD = r',((?:"[^"]*+(?:""[^"]*+)*+"?)?[^,]*+)'
_CSV_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'

# Messages for a value that is not there although its column is,
# for a field that is not there at all, and for failed rules.
REQUIRED = "Field required"
NOT_A_STRING = "Input should be a valid string"
NOT_A_TIME = "Input should be a valid datetime"
NOT_A_DECIMAL = "Decimal input should be an integer, float, string or Decimal object"

# Decimal text: optional sign, digits, optional fraction; and one that keeps all
# rules on digits as it stands, so that only its sign or zero is left to check.
DECIMAL_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"
PLAIN_DECIMAL = r"^[0-9]{1,15}(\.[0-9]{1,3})?\z"


def _err(cond: Column, field: str, message: str) -> Column:
    return F.when(cond, F.struct(F.lit(field).alias("field_name"), F.lit(message).alias("message")))


def decimal_errors(text: Column, field: str, positive: bool, absent: str = REQUIRED) -> list[Column]:
    """max_digits 18, decimal_places 3, >= 0 (or > 0), as one error per field."""
    t = F.trim(text)
    is_num = t.rlike(DECIMAL_PATTERN)
    frac = F.regexp_extract(t, r"\.(\d*)$", 1)
    frac_sig = F.regexp_replace(frac, "0+$", "")
    int_part = F.regexp_replace(F.regexp_extract(t, r"^[+-]?(\d*)", 1), "^0+", "")
    value = t.try_cast("decimal(38,10)")
    bound = (value <= 0) if positive else (value < 0)
    msg = "Input should be greater than 0" if positive else "Input should be greater than or equal to 0"
    full = F.coalesce(
        _err(text.isNull(), field, absent),
        _err(~is_num, field, "Input should be a valid decimal"),
        _err(F.length(frac_sig) > 3, field, "Decimal input should have no more than 3 decimal places"),
        _err(F.length(int_part) + F.length(frac_sig) > 18, field,
             "Decimal input should have no more than 18 digits in total"),
        _err(bound, field, msg),
    )
    plain = _err(~t.rlike("[1-9]") if positive else F.lit(False), field, msg)
    return [F.when(t.rlike(PLAIN_DECIMAL), plain).otherwise(full)]


def string_errors(text: Column, field: str, max_len: int = 100, absent: str = REQUIRED) -> list[Column]:
    return [F.coalesce(
        _err(text.isNull(), field, absent),
        _err(F.length(text) < 1, field, "String should have at least 1 character"),
        _err(F.length(text) > max_len, field, f"String should have at most {max_len} characters"),
    )]


def timestamp_errors(text: Column, field: str, absent: str = REQUIRED) -> list[Column]:
    parsed = X.parse_aware_timestamp(text)
    return [F.coalesce(
        _err(text.isNull(), field, absent),
        _err(~X.has_timezone(F.trim(text)) & X.parse_naive_timestamp(text).isNotNull(), field,
             "Input should have timezone info"),
        _err(parsed.isNull(), field, "Input should be a valid datetime"),
    )]


def _compact(errors: list[Column]) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def _any(errors: list[Column]) -> Column:
    return functools.reduce(operator.or_, [e.isNotNull() for e in errors])


def _each(errors_col: str = "_errors") -> Column:
    """A row per error. For the bare column Catalyst would infer a filter on its
    size and push it below the projection and the join that make it, where the
    parse is then done again for each reference; a condition has no such filter."""
    return F.explode(F.when(F.size(errors_col) > 0, F.col(errors_col)))


def keep_valid(df: DataFrame, errors_col: str = "_errors") -> DataFrame:
    """Rows whose error array is empty.

    Written as a generator rather than a filter on purpose: Catalyst pushes a
    filter below the projection that parses the document and substitutes the
    parse into the condition once per referenced field; a Generate node keeps
    the parse in its child projection, evaluated once per row.
    """
    return keep_where(df, F.size(errors_col) == 0)


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` as a generator (see ``keep_valid``)."""
    gate = F.slice(F.array(F.lit(True)), 1, F.when(cond, 1).otherwise(0))
    return df.select("*", F.explode(gate).alias("_keep")).drop("_keep")


# ----------------------------------------------------------------------------
# Supplier B CSV
# ----------------------------------------------------------------------------
_CSV_ROWS = "file_id {kind}, source_row long, fields array<string>, is_header boolean"


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole CSV files: quoted commas, doubled quotes and line breaks
    belong to their field; blank records are skipped and not counted."""
    csv.field_size_limit(S.MAX_SUPPLIER_B_BYTES)
    for batch in batches:
        kind = batch.schema.field(0).type
        for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
            header = next(reader, [])
            numbered = itertools.chain([(1, header)], enumerate(filter(None, reader), start=2))
            while part := list(itertools.islice(numbered, _ROWS_PER_BATCH)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_id] * len(part), kind), pa.array([n for n, _ in part], pa.int64()),
                     pa.array([f for _, f in part], pa.list_(pa.string())), pa.array([n == 1 for n, _ in part])],
                    names=["file_id", "source_row", "fields", "is_header"])


def supplier_b_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bytes -> numbered CSV records. ``files``: file_id, content (binary) and,
    for file sources, ``length``.

    Returns (rows, file_errors). Rows carry ``fields``, ``is_header`` and
    ``source_row`` (1 for the header, data rows from 2). Oversized and
    non-UTF-8 files become file-level errors. The size gate reads ``length``
    where the source has it, so the bytes of an oversized file are never read
    (the file source skips content by a filter on ``length``).
    """
    size = F.col("length") if "length" in files.columns else F.length("content")
    no_row = [F.lit(None).cast("bigint").alias("source_row"), F.lit(None).cast("string").alias("field_name")]
    large = files.where(size > S.MAX_SUPPLIER_B_BYTES).select(
        "file_id", F.lit("payload_too_large").alias("code"),
        F.lit("Supplier B files must be at most 10 MiB.").alias("message"), *no_row)
    fitting = files.where(size <= S.MAX_SUPPLIER_B_BYTES).select("file_id", "content")
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    garbled = fitting.where(~readable).select(
        "file_id", F.lit("invalid_file_encoding").alias("code"),
        F.lit("Supplier B files must use UTF-8 encoding.").alias("message"), *no_row)
    kind = files.schema["file_id"].dataType.simpleString()
    rows = fitting.where(readable).mapInArrow(_csv_rows, _CSV_ROWS.format(kind=kind))
    return rows, large.unionByName(garbled)


def csv_fields(text: Column) -> Column:
    """Fields of one CSV record held in a text column: any number of fields,
    quoted commas, doubled quotes and line breaks."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_CSV_FIELD), F.lit(1))

    def value(field: Column) -> Column:
        inner = F.regexp_extract(field, _CSV_QUOTED, 1)
        return F.when(field.startswith('"'), F.concat(
            F.replace(inner, F.lit('""'), F.lit('"')), F.regexp_extract(field, _CSV_QUOTED, 2))).otherwise(field)

    return F.when(text.contains('"'), F.transform(raw, value)).otherwise(F.split(text, ",", -1))


def parse_supplier_b(rows: DataFrame, once: Callable[[DataFrame], DataFrame] | None = None,
                     fragments: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV records -> (canonical records, errors). Columns of ``rows``:
    file_id, source_row, fields, is_header.

    Both results come from one table of parsed rows; ``once`` may keep it, so
    that the text is read and parsed a single time. ``fragments``: records carry
    their fields by header name as ``raw_fragment``.
    """
    headers = rows.where("is_header").select("file_id", F.col("fields").alias("_header")).withColumn(
        "_missing", F.array_sort(F.array_except(F.array(*[F.lit(h) for h in S.SUPPLIER_B_REQUIRED_HEADERS]),
                                                F.col("_header")))
    )
    header_errors = keep_where(headers, F.size("_missing") > 0).select(
        "file_id", F.lit("missing_csv_headers").alias("code"),
        F.concat(F.lit("The CSV is missing required headers: "), F.array_join("_missing", ", ")).alias("message"),
        F.lit(None).cast("bigint").alias("source_row"), F.lit(None).cast("string").alias("field_name"),
    )
    # Header names pair with positions; values beyond the header are dropped,
    # absent ones are NULL, duplicate names keep the last: a required name's
    # place is looked up once per file.
    names = S.SUPPLIER_B_REQUIRED_HEADERS
    places = [(F.size("_header") - F.array_position(F.reverse("_header"), h)).cast("int").alias(f"_at_{h}") for h in names]
    good_headers = keep_where(headers, F.size("_missing") == 0).select(
        "file_id", *places, *(["_header"] if fragments else []))
    data = rows.where(~F.col("is_header")).join(good_headers, "file_id").select(
        "file_id", "source_row", *[F.get("fields", F.col(f"_at_{h}")).alias(h) for h in names],
        *([F.map_from_arrays("_header", F.transform("_header", lambda _, i: F.get("fields", i))).alias("raw_fragment")]
          if fragments else []))
    errors = (
        string_errors(F.col("snapshot_ref"), "snapshot_ref", absent=NOT_A_STRING)
        + timestamp_errors(F.col("as_of"), "as_of", absent=NOT_A_TIME)
        + string_errors(F.col("partner_sku"), "partner_sku", absent=NOT_A_STRING)
        + string_errors(F.col("depot"), "depot", absent=NOT_A_STRING)
        + decimal_errors(F.col("case_count"), "case_count", positive=False, absent=NOT_A_DECIMAL)
        + decimal_errors(F.col("units_per_case"), "units_per_case", positive=True, absent=NOT_A_DECIMAL)
    )
    data = data.select("*", *[e.alias(f"_e{i}") for i, e in enumerate(errors)])
    found = [F.col(f"_e{i}") for i in range(len(errors))]
    valid = F.coalesce(*found).isNull()

    def kept(value: Column, name: str) -> Column:
        return F.when(valid, value).alias(name)

    data = data.select(
        "file_id", "source_row",
        kept(F.col("snapshot_ref"), "source_reference"),
        kept(F.col("partner_sku"), "external_sku"),
        kept(F.col("depot"), "external_location"),
        kept(X.parse_aware_timestamp(F.col("as_of")), "observed_at"),
        kept(F.trim("case_count").cast(S.QTY), "on_hand_quantity"),
        kept(F.trim("units_per_case").cast(S.QTY), "units_per_source_unit"),
        *(["raw_fragment"] if fragments else []),
        F.when(~valid, _compact(found)).alias("_errors"))
    if once:
        data = once(data)
    row_errors = data.select(
        "file_id", F.lit("invalid_csv_field").alias("code"), "source_row", _each().alias("_e"),
    ).select("file_id", "code", F.col("_e.message").alias("message"), "source_row",
             F.col("_e.field_name").alias("field_name"))
    records = keep_where(data, F.col("_errors").isNull()).select(
        "file_id", "source_reference", "source_row", "external_sku", "external_location", "observed_at",
        F.lit("CASE").alias("source_unit"), "on_hand_quantity",
        F.lit(0).cast(S.QTY).alias("reserved_quantity"), "units_per_source_unit",
        *(["raw_fragment"] if fragments else []),
    )
    return records, header_errors.unionByName(row_errors)


# ----------------------------------------------------------------------------
# Supplier A JSON
# ----------------------------------------------------------------------------
def parse_supplier_a(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``payloads``: payload_id, value (JSON text). A payload is valid only if
    every field validates; valid payloads explode into records with a 1-based
    ``source_row``; invalid payloads yield one error row per failing field."""
    p = payloads.withColumn("_doc", F.from_json("value", S.SUPPLIER_A_SCHEMA, {"mode": "PERMISSIVE"}))
    items = F.coalesce(F.col("_doc.items"), F.array())

    def per_item(it: Column) -> list[Column]:
        return (
            string_errors(it["item_number"], "item_number")
            + string_errors(it["location"], "location")
            + decimal_errors(it["on_hand"], "on_hand", positive=False)
            + [F.when(it["allocated"].isNotNull(), decimal_errors(it["allocated"], "allocated", positive=False)[0]),
               _err(it["unit"].isNull() | ~it["unit"].isin(*S.UNIT_OF_MEASURE), "unit",
                    "Input should be 'EACH', 'CASE', 'PALLET' or 'KILOGRAM'")]
        )

    item_errors = F.flatten(F.transform(items, lambda it, i: F.transform(
        _compact(per_item(it)), lambda e: F.struct(
            F.concat(F.lit("items."), i.cast("string"), F.lit("."), e["field_name"]).alias("field_name"),
            e["message"].alias("message")))))
    top = (
        [_err(F.col("_doc").isNull(), "payload", "Invalid JSON")]
        + string_errors(F.col("_doc.snapshot_id"), "snapshot_id")
        + timestamp_errors(F.col("_doc.captured_at"), "captured_at")
        + [_err(F.size(items) < 1, "items", "List should have at least 1 item"),
           _err(F.size(items) > S.SUPPLIER_A_MAX_ITEMS, "items", "List should have at most 10000 items")]
    )
    def plain(it: Column) -> Column:
        """True only of items that no rule refuses, so that few items need all rules."""
        return F.coalesce(
            F.length(it["item_number"]).between(1, 100) & F.length(it["location"]).between(1, 100)
            & it["on_hand"].rlike(PLAIN_DECIMAL) & (it["allocated"].isNull() | it["allocated"].rlike(PLAIN_DECIMAL))
            & it["unit"].isin(*S.UNIT_OF_MEASURE), F.lit(False))

    # The same rules as conditions: errors are only made for payloads that have some.
    invalid = _any(top) | F.exists(items, lambda it: ~plain(it) & _any(per_item(it)))
    errors = p.withColumn("_errors", F.when(invalid, F.concat(_compact(top), item_errors))).select(
        "payload_id", _each().alias("_e")
    ).select("payload_id", F.lit("invalid_payload").alias("code"), F.col("_e.message").alias("message"),
             F.lit(None).cast("bigint").alias("source_row"), F.col("_e.field_name").alias("field_name"))
    # What all items share is taken from the document before they become rows, so that none carries the document.
    records = p.select(
        "payload_id", F.col("_doc.snapshot_id").alias("source_reference"),
        X.parse_aware_timestamp(F.col("_doc.captured_at")).alias("observed_at"),
        F.when(~invalid, F.col("_doc.items")).alias("_items"),
    ).select(
        "payload_id", "source_reference", "observed_at",
        F.posexplode(F.when(F.size("_items") > 0, F.col("_items"))).alias("_pos", "_it"),
    ).select(
        "payload_id", "source_reference", (F.col("_pos") + 1).cast("bigint").alias("source_row"),
        F.col("_it.item_number").alias("external_sku"), F.col("_it.location").alias("external_location"),
        "observed_at", F.col("_it.unit").alias("source_unit"),
        F.trim("_it.on_hand").cast(S.QTY).alias("on_hand_quantity"),
        F.coalesce(F.trim("_it.allocated").cast(S.QTY), F.lit(0).cast(S.QTY)).alias("reserved_quantity"),
        F.lit(None).cast(S.QTY).alias("units_per_source_unit"),
        F.create_map(
            F.lit("item_number"), F.col("_it.item_number"), F.lit("location"), F.col("_it.location"),
            F.lit("on_hand"), F.col("_it.on_hand"),
            F.lit("allocated"), F.coalesce(F.col("_it.allocated"), F.lit("0")),
            F.lit("unit"), F.col("_it.unit")).alias("raw_fragment"),
    )
    return records, errors


# ----------------------------------------------------------------------------
# Carrier C events
# ----------------------------------------------------------------------------
def parse_carrier_events(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON events -> canonical shipment events (+ rejects). The event type is
    lower-cased then checked against the enum; the time must carry an offset
    and is converted to UTC."""
    e = raw.withColumn("_ev", F.from_json(F.col(value_col), S.CARRIER_EVENT_SCHEMA))
    etype = F.lower(F.col("_ev.event"))
    errs = _compact(
        string_errors(F.col("_ev.event_id"), "event_id")
        + string_errors(F.col("_ev.tracking_number"), "tracking_number")
        + [F.when(etype.isNull() | ~etype.isin(*S.SHIPMENT_EVENT_TYPE),
                  F.struct(F.lit("event").alias("field_name"), F.lit("Input should be a valid event type")
                           .alias("message")))]
        + timestamp_errors(F.col("_ev.event_time"), "event_time")
        + [F.when(F.length("_ev.reason_code") > 100,
                  F.struct(F.lit("reason_code").alias("field_name"),
                           F.lit("String should have at most 100 characters").alias("message")))]
    )
    e = e.withColumn("_errors", errs)
    keep = [c for c in raw.columns if c != value_col]
    rejects = e.select(
        *keep, F.col("_ev.event_id").alias("external_event_id"), _each().alias("_e")
    ).select(*keep, "external_event_id", F.col("_e.field_name").alias("field_name"),
             F.col("_e.message").alias("message"))
    events = keep_valid(e).select(
        *keep,
        F.col("_ev.event_id").alias("external_event_id"),
        F.col("_ev.tracking_number").alias("tracking_reference"),
        etype.alias("event_type"),
        X.parse_aware_timestamp(F.col("_ev.event_time")).alias("occurred_at"),
        F.col("_ev.reason_code").alias("reason_code"),
    )
    return events, rejects
