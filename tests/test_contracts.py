"""Golden partner contracts, worked domain examples and adapter registry."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skuflow.functions import scalars as X
from skuflow.operators import imports, lifecycle, mappings, partners, reconcile, registry, reports

SUPPLIER_A = {"snapshot_id": "SA-20260729-001", "captured_at": "2026-07-29T08:00:00-07:00",
              "items": [{"item_number": "A-IP16-256-BLK", "location": "A-WEST-01", "on_hand": "120.000",
                         "allocated": "35.000", "unit": "EACH"}]}
SUPPLIER_B = ("snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case\n"
              "SB-20260729-001,2026-07-29T08:00:00-07:00,B-IP16-256-BLK,B-LAX-01,10.000,12.000\n")
CARRIER_C = {"event_id": "C-EVT-90871", "tracking_number": "C-123456", "event": "PICKED_UP",
             "event_time": "2026-07-29T13:00:00-07:00", "reason_code": None}


def _files(spark, rows):
    return spark.createDataFrame([(fid, bytearray(c.encode("utf-8") if isinstance(c, str) else c))
                                  for fid, c in rows], "file_id string, content binary")


def test_supplier_a_contract(spark):
    payloads = spark.createDataFrame([("p1", json.dumps(SUPPLIER_A))], "payload_id string, value string")
    recs, errs = partners.parse_supplier_a(payloads)
    r = recs.collect()
    assert errs.count() == 0 and len(r) == 1
    assert r[0].source_unit == "EACH" and r[0].source_row == 1
    assert r[0].observed_at == dt.datetime(2026, 7, 29, 15, 0)
    assert str(r[0].on_hand_quantity) == "120.000" and str(r[0].reserved_quantity) == "35.000"


def test_supplier_a_whole_payload_invalid(spark):
    bad = dict(SUPPLIER_A, items=[dict(SUPPLIER_A["items"][0], unit="BOX"), SUPPLIER_A["items"][0]])
    payloads = spark.createDataFrame([("p1", json.dumps(bad)), ("p2", "{oops")], "payload_id string, value string")
    recs, errs = partners.parse_supplier_a(payloads)
    assert recs.count() == 0
    fields = {(e.payload_id, e.field_name) for e in errs.collect()}
    assert ("p1", "items.0.unit") in fields and any(p == "p2" for p, _ in fields)


def test_supplier_b_contract_and_bad_row(spark):
    content = SUPPLIER_B + "SB-BAD,not-a-time,B-SKU,B-WH,-2,0\n"
    lines, ferr = partners.supplier_b_rows(_files(spark, [("f1", "﻿" + content)]))
    recs, errs = partners.parse_supplier_b(lines)
    r = recs.collect()
    assert ferr.count() == 0 and len(r) == 1
    assert r[0].source_row == 2 and r[0].source_unit == "CASE"
    assert str(r[0].on_hand_quantity) == "10.000" and str(r[0].units_per_source_unit) == "12.000"
    assert r[0].observed_at == dt.datetime(2026, 7, 29, 15, 0)
    bad = sorted((e.source_row, e.field_name, e.code) for e in errs.collect())
    assert bad == [(3, "as_of", "invalid_csv_field"), (3, "case_count", "invalid_csv_field"),
                   (3, "units_per_case", "invalid_csv_field")]


def test_supplier_b_headers_any_order_missing_and_encoding(spark):
    reordered = "depot,units_per_case,as_of,partner_sku,snapshot_ref,case_count,extra\n" \
                "B-LAX-01,12.000,2026-07-29T15:00:00Z,B-SKU,SB-1,1.000,x,y\n\n"
    missing = "snapshot_ref,partner_sku\nSB-1,B-SKU\n"
    lines, ferr = partners.supplier_b_rows(_files(spark, [
        ("ok", reordered), ("miss", missing), ("enc", b"\xff\xfe\x00bad"),
    ]))
    recs, errs = partners.parse_supplier_b(lines)
    assert [(r.file_id, r.external_location, r.source_row) for r in recs.collect()] == [("ok", "B-LAX-01", 2)]
    e = {(x.file_id, x.code, x.message) for x in errs.collect()}
    assert ("miss", "missing_csv_headers",
            "The CSV is missing required headers: as_of, case_count, depot, units_per_case") in e
    assert [(x.file_id, x.code) for x in ferr.collect()] == [("enc", "invalid_file_encoding")]


def test_supplier_b_quotes_line_breaks_wide_and_blank_headers(spark):
    head = "snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case"
    row = "2026-07-29T15:00:00Z,SKU,WH,1.000,2.000"
    wide = ",".join(f"x{i}" for i in range(34))
    files = {
        "quotes": f'{head}\n"S ""1"" a",{row}\n',
        "breaks": f'{head}\r\n"S\n1",{row}\r\n\r\nS2,{row}\r\n',
        "wide": f"{wide},{head}\n{','.join('0' * 34)},S3,{row}\n",
        "blank": f"a,,{head}\n1,2,S4,{row}\n",
        "empty": f"{head}\n,{row}\n",
        "short": f"{head}\nS5,2026-07-29T15:00:00Z,SKU\n",
        "nothing": "",
    }
    rows, ferr = partners.supplier_b_rows(_files(spark, list(files.items())))
    recs, errs = partners.parse_supplier_b(rows)
    got = {(r.file_id, r.source_row): r.source_reference for r in recs.collect()}
    assert got == {("quotes", 2): 'S "1" a', ("breaks", 2): "S\n1", ("breaks", 3): "S2", ("wide", 2): "S3",
                   ("blank", 2): "S4"}
    bad = {(e.file_id, e.field_name, e.message) for e in errs.collect()}
    assert ("empty", "snapshot_ref", "String should have at least 1 character") in bad
    assert ("short", "depot", "Input should be a valid string") in bad
    assert any(f == "nothing" and m.startswith("The CSV is missing required headers") for f, _, m in bad)
    assert ferr.count() == 0


def test_csv_fields_of_one_record(spark):
    cases = [("a,b", ["a", "b"]), (",a,", ["", "a", ""]), ('"x, ""y"" z",1', ['x, "y" z', "1"]), ('"l\n2"', ["l\n2"]),
             ('q"r,"s"t', ['q"r', "st"]), ("", [""])]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r[0] for r in df.select(partners.csv_fields(df.text)).collect()] == [f for _, f in cases]


def test_payload_size_gate(spark):
    big = "x" * (10 * 1024 * 1024 + 1)
    _, ferr = partners.supplier_b_rows(_files(spark, [("big", big)]))
    assert [r.code for r in ferr.collect()] == ["payload_too_large"]


def test_carrier_contract(spark):
    raw = spark.createDataFrame([(1, json.dumps(CARRIER_C))], "arrival_seq long, value string")
    ev, rej = partners.parse_carrier_events(raw)
    r = ev.collect()
    assert rej.count() == 0 and r[0].event_type == "picked_up"
    assert r[0].occurred_at == dt.datetime(2026, 7, 29, 20, 0)


def test_lifecycle_vertical_slice(spark):
    t = dt.datetime(2026, 7, 29, 10)
    ev = spark.createDataFrame([
        (1, "e1", "T-1", "picked_up", t), (2, "e2", "T-1", "in_transit", t + dt.timedelta(hours=1)),
        (3, "e3", "T-1", "delivered", t + dt.timedelta(hours=2)), (4, "e3", "T-1", "delivered", t),
        (5, "e4", "T-1", "cancelled", t), (6, "x1", "T-2", "delivered", t), (7, "x2", "T-9", "picked_up", t),
    ], "arrival_seq long, external_event_id string, tracking_reference string, event_type string, "
       "occurred_at timestamp")
    ships = spark.createDataFrame([("S1", "T-1", "SUP-1"), ("S2", "T-2", "SUP-1")],
                                  "shipment_id string, tracking_reference string, supplier_id string")
    v = {r.arrival_seq: r.verdict for r in lifecycle.event_verdicts(ev, ships).collect()}
    assert v == {1: "accepted", 2: "accepted", 3: "accepted", 4: "duplicate", 5: "illegal_transition",
                 6: "illegal_transition", 7: "not_found"}
    st = {r.shipment_id: r for r in lifecycle.shipment_states(lifecycle.event_verdicts(ev, ships), ships).collect()}
    assert st["S1"].status == "delivered" and st["S1"].accepted_events == 3
    assert st["S1"].shipped_at == t and st["S1"].delivered_at == t + dt.timedelta(hours=2)
    assert st["S2"].status == "planned"


def test_retry_delays_and_classification(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 8)], "n int")
    assert [r.d for r in df.select(X.retry_delay_seconds("n").alias("d")).collect()] == [2, 4, 8, 16, 32, 60, 60]
    errs = spark.createDataFrame([("TimeoutError",), ("PermanentImportError",), ("KeyError",)], "e string")
    retry, code = X.classify_failure("e")
    assert [tuple(r) for r in errs.select(retry, code).collect()] == [
        (True, "transient_timeout"), (False, "permanent_import_error"), (False, "unexpected_import_error")]


def test_mapping_versions_and_asof(spark):
    t = dt.datetime(2026, 7, 1)
    up = spark.createDataFrame([
        ("K", 1, t, 6.0), ("K", 2, t + dt.timedelta(days=1), 6.0), ("K", 3, t + dt.timedelta(days=2), 12.0),
    ], "k string, seq int, ts timestamp, factor double")
    v = mappings.versions(up, ["k"], ["factor"], ["seq"])
    assert [r.version for r in v.orderBy("seq").collect()] == [1, 1, 2]
    hist = mappings.intervals(v, ["k"], "ts", ["seq"])
    facts = spark.createDataFrame([("K", t + dt.timedelta(hours=1), 2.0), ("K", t + dt.timedelta(days=3), 2.0)],
                                  "k string, at timestamp, cases double")
    got = mappings.as_of(facts, hist, ["k"], "at", ["version", "factor"]).orderBy("at").collect()
    assert [(r.version, r.factor * r.cases) for r in got] == [(1, 12.0), (2, 24.0)]


def test_reconcile_examples(spark):
    s = spark.createDataFrame([(1, "S", "SKU-2", "W", 17), (0, "S", "SKU-1", "W", 10)],
                              "record_index long, supplier_code string, product_sku string, warehouse_code string, "
                              "reported_quantity long")
    h = spark.createDataFrame([(1, "SKU-2", "W", 20), (0, "SKU-1", "W", 10)],
                              "record_index long, product_sku string, warehouse_code string, hub_quantity long")
    r = reconcile.sort_by_record_index(reconcile.reconcile(s, h)).collect()
    assert [(x.record_index, x.matches, x.difference_quantity) for x in r] == [(0, True, 0), (1, False, -3)]
    h2 = spark.createDataFrame([(0, "DIFFERENT", "W", 10), (1, "SKU-2", "W", 20)], h.schema)
    with pytest.raises(Exception, match="matching keys"):
        reconcile.reconcile(s, h2).collect()
    dup = h.unionByName(h.limit(1))
    assert reconcile.violations(s, dup).count() >= 1
    eq = reconcile.outputs_equal(reconcile.reconcile(s, h, "merge"), reconcile.reconcile(s, h, "broadcast")).first()
    assert eq.outputs_equal


def test_idempotent_submissions(spark):
    t = dt.datetime(2026, 7, 29)
    jobs = spark.createDataFrame([
        ("J1", 1, "S", "supplier_b_csv", "key-0001", "h1", t), ("J2", 2, "S", "supplier_b_csv", "key-0001", "h1",
                                                                 t + dt.timedelta(seconds=1)),
        ("J3", 3, "S", "supplier_b_csv", "key-0001", "h2", t + dt.timedelta(seconds=2)),
    ], "job_id string, job_key long, supplier_id string, source_type string, idempotency_key string, "
       "content_sha256 string, created_at timestamp")
    out = {r.job_id: (r.outcome, r.original_job_id) for r in reports.idempotent_submissions(jobs).collect()}
    assert out == {"J1": ("created", "J1"), "J2": ("duplicate", "J1"), "J3": ("conflict", "J1")}


def test_positions_last_write_wins_and_versions(spark):
    snaps = spark.createDataFrame([
        (1, 2, "W", "P", 5.0, 0.0), (1, 1, "W", "P", 7.0, 1.0), (2, 1, "W", "P", 3.0, 0.0),
    ], "job_seq int, source_row long, warehouse_id string, product_id string, on_hand_quantity double, "
       "reserved_quantity double")
    p = imports.positions(snaps).first()
    assert (p.on_hand_quantity, p.version) == (3.0, 3)
    cur = spark.createDataFrame([("W", "P", 1.0, 0.0, 4)], "warehouse_id string, product_id string, "
                                "on_hand_quantity double, reserved_quantity double, version int")
    assert imports.positions(snaps, cur).first().version == 7


def test_adapter_registry(spark):
    payloads = spark.createDataFrame([
        ("J1", "supplier_a_json", bytearray(json.dumps(SUPPLIER_A).encode())),
        ("J2", "supplier_b_csv", bytearray(SUPPLIER_B.encode())),
        ("J3", "supplier_z_xml", bytearray(b"<x/>")),
    ], "job_id string, source_type string, content binary")
    recs, errs = registry.adapt(payloads)
    assert sorted(r.job_id for r in recs.collect()) == ["J1", "J2"]
    assert [(e.job_id, e.code) for e in errs.collect()] == [("J3", "permanent_import_error")]
    v = {r.job_id: r.adapter_version for r in registry.adapter_versions(payloads).collect()}
    assert v == {"J1": "supplier-a.inventory.v1", "J2": "supplier-b.inventory-csv.v1", "J3": None}


def test_valid_timezone(spark):
    df = spark.createDataFrame([("W1", "Europe/Berlin"), ("W2", "Mars/Olympus")], "warehouse_id string, timezone string")
    got = {r.warehouse_id: r.timezone_valid for r in X.with_timezone_valid(df).collect()}
    assert got == {"W1": True, "W2": False}


def test_code_rules(spark):
    df = spark.createDataFrame([(" sup_1 ",), ("#bad",), ("a",)], "c string")
    rows = df.select(X.normalize_code("c").alias("n"), X.code_valid("c").alias("ok")).collect()
    assert [(r.n, r.ok) for r in rows] == [("SUP_1", True), ("#BAD", False), ("A", False)]
    ids = spark.createDataFrame([("abc/../x y",), ("k" * 200,)], "r string")
    safe = [r.s for r in ids.select(X.safe_run_id("r").alias("s")).collect()]
    assert safe[0] == "abc_.._x_y" and len(safe[1]) == 180
    keys = spark.createDataFrame([("key-0001",), ("short",), ("-leading1",)], "k string")
    assert [r.v for r in keys.select(X.idempotency_key_valid("k").alias("v")).collect()] == [True, False, False]


def test_payloads_are_parsed_once_per_row(spark):
    """No parse may be copied into conditions below it (a filter that Catalyst infers for the errors)."""
    ids = spark.createDataFrame([("p1",)], "payload_id string").repartition(2)
    payloads = spark.createDataFrame([("p1", json.dumps(SUPPLIER_A))], "payload_id string, value string").join(ids, "payload_id")
    _, errs = partners.parse_supplier_a(payloads)
    plan = errs.select("payload_id", "field_name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    lines, _ = partners.supplier_b_rows(_files(spark, [("f1", SUPPLIER_B)]))
    _, errs = partners.parse_supplier_b(lines)
    plan = errs.where("code = 'invalid_csv_field'").select("file_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan
    assert not [line for line in plan.split("\n") if "Join" in line and "RLIKE" in line]


def test_payload_items_carry_no_document_and_errors_are_made_for_bad_ones_only(spark):
    item = SUPPLIER_A["items"][0]
    docs = {"ok": [item, {k: v for k, v in item.items() if k != "allocated"}, dict(item, on_hand=" +7. ")], "none": [],
            "bad": [item, dict(item, on_hand="-1", unit="BOX"), dict(item, location="", allocated="1.2345")],
            "null": [None, dict(item, item_number="x" * 101)]}
    payloads = spark.createDataFrame([(k, json.dumps(dict(SUPPLIER_A, items=v))) for k, v in docs.items()]
                                     + [("broken", "{oops"), (None, None)], "payload_id string, value string")
    recs, errs = partners.parse_supplier_a(payloads)
    assert sorted((r.payload_id, r.source_row, str(r.on_hand_quantity), str(r.reserved_quantity)) for r in recs.collect()) == [
        ("ok", 1, "120.000", "35.000"), ("ok", 2, "120.000", "0.000"), ("ok", 3, "7.000", "35.000")]
    found = [(e.payload_id, e.field_name) for e in errs.collect()]
    assert [f for p, f in found if p == "bad"] == [
        "items.1.on_hand", "items.1.unit", "items.2.location", "items.2.allocated"]
    assert [f for p, f in found if p == "null"] == [
        "items.0.item_number", "items.0.location", "items.0.on_hand", "items.0.unit", "items.1.item_number"]
    assert [f for p, f in found if p == "none"] == ["items"] and {p for p, _ in found} == {"bad", "null", "none", "broken", None}
    plan = recs.drop("raw_fragment")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    # No row of an item holds its whole document, and records need no error structs of every item.
    explode = next(line for line in plan.split("\n") if "posexplode" in line)
    assert "_doc" not in explode and "items." not in plan.replace("_doc", "").replace("[items,", "")


def test_payload_rows_meet_unrendered_and_keep_their_order(spark, tmp_out):
    """Repeated, missing and plain line numbers; quantities that a cast and a format could write differently."""
    from skuflow.sources import views

    rows = [(1, 3, 5, 7, 1.0005, 10.0, 0.1), (1, 1, 6, 8, 0.0, 11.0, 0.2), (1, 1, 7, 9, -0.0001, 12.0, 0.3),
            (1, 1, 8, 9, 2e9, 12.5, 0.5), (2, None, 9, 1, 2.5, 1.0, 0.9), (2, 2, 29, 2, 3.0, 1.0, 0.9), (None, 1, 9, 1, 1.0, 1.0, 0.0)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                                     "l_extendedprice double, l_discount double")
    li.write.parquet(f"{tmp_out}/lineitem.parquet")
    spark.createDataFrame([(1, dt.datetime(2026, 1, 2)), (2, None), (None, dt.datetime(2026, 1, 2))],
                          "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_out}/orders.parquet")
    df = views.supplier_a_payloads(spark, tmp_out)
    docs = {r.payload_id: json.loads(r.value) for r in df.collect()}
    assert set(docs) == {"SA-1", "SA-2"} and "captured_at" not in docs["SA-2"]
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    order = li.where("l_orderkey = 1").select("l_partkey", "l_linenumber", views.row_key(*key).alias("k")).orderBy(
        "l_linenumber", "k").collect()
    assert [i["item_number"] for i in docs["SA-1"]["items"]] == [f"EXT-{r.l_partkey}" for r in order]
    assert {i["item_number"]: i["on_hand"] for i in docs["SA-1"]["items"]} == {
        "EXT-5": "1.001", "EXT-6": "0.000", "EXT-7": "-0.000", "EXT-8": "2000000000.000"}
    assert [(i["unit"], i.get("allocated")) for i in docs["SA-2"]["items"]] == [("CASE", "2.000"), ("BOX", None)]
    # The shuffle of line items takes the table's columns; text is made behind it.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EXT-" not in plan[plan.index("Exchange hashpartitioning(l_orderkey"):].split("o_orderkey")[0]


def test_decimal_text_rules(spark):
    cases = {"5": None, "5.125": None, "0": "greater than 0", "0.000": "greater than 0", "-1": "greater than 0", "1.2345": "3 decimal",
             "1.2340": None, "1234567890123456": "18 digits", "123456789012345.123": None, "+1": None, ".5": None, "5.": None,
             " 7 ": None, "7\n": None, "x": "valid decimal", "": "valid decimal", None: "Field required", "00000000000000000007": None,
             "٣": "valid decimal"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    e = partners.decimal_errors(df.t, "q", positive=True)[0].message.alias("m")
    got = {r.t: r.m for r in df.select("t", e).collect()}
    for text, want in cases.items():
        if text != "1234567890123456":
            assert (got[text] is None) if want is None else want in got[text], text
    assert got["1234567890123456"] is None
