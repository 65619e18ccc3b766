"""Structured Streaming: batch = stream for the lifecycle and request rate,
exactly-once supplier-file imports."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from skuflow.operators import lifecycle, partners, telemetry
from skuflow.sources import views
from skuflow.streaming import carrier, imports as import_stream
from skuflow.streaming import telemetry as tstream
from tests.conftest import SF001

CONTRACT_A = {"snapshot_id": "SA-20260729-001", "captured_at": "2026-07-29T08:00:00-07:00",
              "items": [{"item_number": "A-IP16-256-BLK", "location": "A-WEST-01", "on_hand": "120.000",
                         "allocated": "35.000", "unit": "EACH"}]}
CONTRACT_B = (b"snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case\n"
              b"SB-20260729-001,2026-07-29T08:00:00-07:00,B-IP16-256-BLK,B-LAX-01,10.000,12.000\n"
              b"SB-20260729-002,2026-07-29T15:00:00Z,UNMAPPED-SKU,B-LAX-01,3.000,12.000\n")


def test_an_ended_shipment_is_not_judged_afresh(spark):
    import datetime as dt

    t = dt.datetime(2026, 7, 1, 12)

    def event(seq, ref, eid, kind, at):
        return (seq, json.dumps({"event_id": eid, "tracking_number": ref, "event": kind,
                                 "event_time": at.strftime("%Y-%m-%dT%H:%M:%SZ")}))

    batches = [[event(1, "T1", "E1", "PICKED_UP", t), event(2, "T1", "E2", "DELIVERED", t + dt.timedelta(hours=1))],
               [event(3, "T2", "E3", "PICKED_UP", t + dt.timedelta(days=4))],
               [event(4, "T2", "E4", "IN_TRANSIT", t + dt.timedelta(days=4, hours=1))],
               [event(5, "T1", "E5", "PICKED_UP", t + dt.timedelta(days=4, hours=2)),
                event(6, "T1", "E2", "DELIVERED", t + dt.timedelta(days=4, hours=2))]]
    src = tempfile.mkdtemp(prefix="ended-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "arrival_seq long, value string").coalesce(1).write.json(f"{src}/b={i}")
        os.utime(f"{src}/b={i}", (1_700_000_000 + i,) * 2)
    ships = spark.createDataFrame([("S1", "T1", "SUP"), ("S2", "T2", "SUP")],
                                  "shipment_id string, tracking_reference string, supplier_id string")
    stream = spark.readStream.schema("arrival_seq long, value string").option("maxFilesPerTrigger", 1).json(f"{src}/*")
    q = _run_memory(carrier.lifecycle_stream(stream, ships), "ended_stream")
    got = {r.arrival_seq: (r.verdict, r.status_after) for r in spark.table("ended_stream").collect()}
    q.stop()
    assert got[1] == ("accepted", "picked_up") and got[2] == ("accepted", "delivered") and got[4][0] == "accepted"
    assert got[5] == ("after_end", "delivered") and got[6] == ("after_end", "delivered")


def _run_memory(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240), f"stream {name} did not finish"
    return q


def test_lifecycle_stream_equals_batch(spark):
    raw = views.carrier_raw(spark, SF001)
    ships = views.shipments(spark, SF001)
    inbox = tempfile.mkdtemp(prefix="carrier-inbox-")
    bounds = raw.agg(F.max("arrival_seq")).first()[0]
    cuts = [0, bounds // 3, 2 * bounds // 3, bounds + 1]
    for i in range(3):
        (raw.where((F.col("arrival_seq") >= cuts[i]) & (F.col("arrival_seq") < cuts[i + 1]))
         .coalesce(1).write.mode("overwrite").json(f"{inbox}/part={i}"))
    stream = (spark.readStream.schema("arrival_seq long, value string").option("maxFilesPerTrigger", 1)
              .json(f"{inbox}/*"))
    q = _run_memory(carrier.lifecycle_stream(stream, ships), "lifecycle_stream")
    got = {(r.arrival_seq, r.verdict, r.status_after) for r in spark.table("lifecycle_stream").collect()}
    events, _ = partners.parse_carrier_events(raw)
    batch = lifecycle.event_verdicts(events, ships).where(F.col("match_status") == "matched")
    want = {(r.arrival_seq, r.verdict, r.status_after) for r in batch.collect()}
    q.stop()
    assert got == want and len(want) > 0


SUP_A, SUP_B = "SUP-A", "SUP-B"


def _maps(spark):
    pm = spark.createDataFrame(
        [(SUP_B, "B-IP16-256-BLK", "PRD-1", "CASE", 12.0, 1, True), (SUP_A, "A-IP16-256-BLK", "PRD-1", "EACH", 1.0, 1, True),
         (SUP_A, "B-IP16-256-BLK", "PRD-2", "CASE", 6.0, 1, True)],
        "supplier_id string, external_sku string, product_id string, source_unit string, "
        "units_per_source_unit double, version int, active boolean") \
        .withColumn("units_per_source_unit", F.col("units_per_source_unit").cast("decimal(18,3)"))
    wm = spark.createDataFrame([(SUP_B, "B-LAX-01", "WH-1", 1, True), (SUP_A, "A-WEST-01", "WH-2", 1, True)],
                               "supplier_id string, external_location string, warehouse_id string, version int, active boolean")
    return pm, wm


def _deliver(inbox, supplier, name, content):
    folder = os.path.join(inbox, f"supplier_id={supplier}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(content)


def _import(spark, inbox, out, ckpt, **options):
    q = import_stream.start_import_stream(spark, inbox, out, ckpt, *_maps(spark), **options)
    assert q.awaitTermination(300)


def _snapshots(spark, out):
    return sorted((r.supplier_id, r.source_reference, r.product_id, str(r.on_hand_quantity))
                  for r in spark.read.parquet(f"{out}/snapshots").collect())


def test_import_stream_exactly_once(spark):
    inbox, out, ckpt = (tempfile.mkdtemp(prefix=f"b-{x}-") for x in ("inbox", "out", "ckpt"))
    _deliver(inbox, SUP_B, "a.csv", CONTRACT_B)
    _deliver(inbox, SUP_B, "a-again.csv", CONTRACT_B)  # same bytes re-delivered
    _deliver(inbox, SUP_A, "snapshot.json", json.dumps(CONTRACT_A).encode())
    _import(spark, inbox, out, ckpt)
    snaps = {r.warehouse_id: r for r in spark.read.parquet(f"{out}/snapshots").collect()}
    assert set(snaps) == {"WH-1", "WH-2"}
    assert str(snaps["WH-1"].on_hand_quantity) == "120.000"  # 10 cases x 12
    assert (str(snaps["WH-2"].on_hand_quantity), str(snaps["WH-2"].reserved_quantity)) == ("120.000", "35.000")
    acc = sorted((a.accepted_records, a.rejected_records, a.total_records, a.status)
                 for a in spark.read.parquet(f"{out}/accounting").collect())
    assert acc == [(1, 0, 1, "completed"), (1, 1, 2, "completed_with_errors")]
    errs = spark.read.parquet(f"{out}/errors").collect()
    assert [(e.source_row, e.code) for e in errs] == [(3, "product_mapping_not_found")]
    stages = sorted((e.stage, e.status) for e in spark.read.parquet(f"{out}/events").collect())
    assert stages == [("job.completed", "completed"), ("job.completed", "completed_with_errors"),
                      ("payload.stored", "succeeded"), ("payload.stored", "succeeded")]
    # a re-run of the same inbox adds nothing
    _import(spark, inbox, out, ckpt)
    assert spark.read.parquet(f"{out}/snapshots").count() == 2
    # the same record in a later file is a duplicate, also under another hash; a new one is a second write
    _deliver(inbox, SUP_B, "b.csv", CONTRACT_B + b"SB-20260729-003,2026-07-29T16:00:00Z,B-IP16-256-BLK,B-LAX-01,4.000,12.000\n")
    _import(spark, inbox, out, ckpt)
    assert spark.read.parquet(f"{out}/snapshots").count() == 3
    codes = sorted((e.source_row, e.code) for e in spark.read.parquet(f"{out}/errors").where("batch_id = 1").collect())
    assert codes == [(2, "duplicate_source_record"), (3, "product_mapping_not_found")]
    positions = {r.warehouse_id: (r.product_id, str(r.on_hand_quantity), r.version)
                 for r in import_stream.current_positions(spark, out).collect()}
    assert positions == {"WH-1": ("PRD-1", "48.000", 2), "WH-2": ("PRD-1", "120.000", 1)}


def test_a_retried_import_batch_replaces_its_output(spark):
    inbox, out = tempfile.mkdtemp(prefix="r-inbox-"), tempfile.mkdtemp(prefix="r-out-")
    _deliver(inbox, SUP_B, "a.csv", CONTRACT_B)
    _deliver(inbox, SUP_A, "s.json", json.dumps(CONTRACT_A).encode())
    files = spark.read.format("binaryFile").schema(import_stream.BINARY_FILE_SCHEMA).option(
        "recursiveFileLookup", "true").load(inbox)
    import_stream.prepare_output(spark, out)
    import_stream.process_batch(files, 0, out, *_maps(spark))
    before = _snapshots(spark, out)
    import_stream.process_batch(files, 0, out, *_maps(spark))  # as if the commit had been lost
    assert _snapshots(spark, out) == before and len(before) == 2
    import_stream.process_batch(files, 1, out, *_maps(spark))  # delivered once more
    assert _snapshots(spark, out) == before


def test_import_stream_equals_batch(spark):
    """Files one by one through the stream, and all at once through the batch operator."""
    from skuflow.operators import imports, partners

    inbox, out, ckpt = (tempfile.mkdtemp(prefix=f"e-{x}-") for x in ("inbox", "out", "ckpt"))
    head = b"snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case\n"
    line = "{},2026-07-29T15:00:00Z,{},B-LAX-01,{}.000,{}\n"
    contents = [head + "".join(line.format(f"R{(i * 3 + j) % 7}", "B-IP16-256-BLK" if j % 4 else "NOPE", i + j,
                                           "12.000" if j % 5 else "7.000") for j in range(9)).encode() for i in range(4)]
    for i, c in enumerate(contents):
        _deliver(inbox, SUP_B, f"f{i}.csv", c)
        os.utime(os.path.join(inbox, f"supplier_id={SUP_B}", f"f{i}.csv"), (1_700_000_000 + 10 * i,) * 2)
    _import(spark, inbox, out, ckpt, max_files=1)
    jobs = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "file_id string, content binary")
    records, _ = partners.parse_supplier_b(partners.supplier_b_rows(jobs)[0])
    feed = records.select(
        F.col("file_id").alias("import_job_id"), F.col("file_id").cast("long").alias("job_seq"), F.lit(SUP_B).alias("supplier_id"),
        "source_reference", "source_row", "external_sku", "external_location", "observed_at", "source_unit",
        "on_hand_quantity", "reserved_quantity", "units_per_source_unit")
    accepted = imports.snapshots(imports.verdicts(feed, *_maps(spark)))
    want = sorted((r.supplier_id, r.source_reference, r.product_id, str(r.on_hand_quantity)) for r in accepted.collect())
    assert _snapshots(spark, out) == want and len(want) > 3
    assert spark.read.parquet(f"{out}/accounting").select("batch_id").distinct().count() == 4
    got = {(r.warehouse_id, r.product_id, str(r.on_hand_quantity), r.version)
           for r in import_stream.current_positions(spark, out).collect()}
    assert got == {(r.warehouse_id, r.product_id, str(r.on_hand_quantity), r.version)
                   for r in imports.positions(accepted).collect()}


def test_request_rate_stream_closed_windows_equal_batch(spark):
    log = views.http_log(spark, SF001)
    src = tempfile.mkdtemp(prefix="http-log-")
    days = [r[0] for r in log.select(F.to_date("completed_at").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days):
        log.where(F.to_date("completed_at") == d).coalesce(1).write.mode("overwrite").parquet(f"{src}/d={i:03d}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = _run_memory(tstream.request_rate_stream(stream), "rate_stream")
    got = {(r.window_start, r.status, r.requests) for r in spark.table("rate_stream").collect()}
    q.stop()
    batch = {(r.window_start, r.status, r.requests) for r in telemetry.request_rate(log).collect()}
    assert got and got <= batch
    # every window that closed before the final watermark is emitted
    last = log.agg(F.max("completed_at")).first()[0]
    import datetime as dt
    closed = {b for b in batch if b[0] + dt.timedelta(minutes=5) <= last - dt.timedelta(minutes=10)}
    assert closed <= got


def test_tail_job_events(spark):
    import datetime as dt
    t = dt.datetime(2026, 7, 29, 12, 0, 0)
    rows = [("JOB-1", "E1", t, "succeeded"), ("JOB-1", "E2", t + dt.timedelta(seconds=1), "failed"),
            ("JOB-1", "E3", t + dt.timedelta(seconds=2), "succeeded"), ("JOB-2", "E4", t, "succeeded")]
    src = tempfile.mkdtemp(prefix="op-events-")
    spark.createDataFrame(rows, "job_id string, event_id string, occurred_at timestamp, status string") \
        .coalesce(1).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("job_id string, event_id string, occurred_at timestamp, status string") \
        .parquet(src)
    q = _run_memory(tstream.tail_job_events(stream), "tail_events")
    out = {(r.job_id, r.event_id, r.kind) for r in spark.table("tail_events").collect()}
    q.stop()
    assert out == {("JOB-1", "E1", "event"), ("JOB-1", "E2", "event"), ("JOB-1", None, "completed"),
                   ("JOB-2", "E4", "event")}


def test_latency_stream_closed_windows_equal_batch(spark):
    import datetime as dt

    log = views.http_log(spark, SF001)
    src = tempfile.mkdtemp(prefix="http-log-p95-")
    days = [r[0] for r in log.select(F.to_date("completed_at").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days[:6]):
        log.where(F.to_date("completed_at") == d).coalesce(1).write.mode("overwrite").parquet(f"{src}/d={i:03d}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = _run_memory(tstream.latency_stream(stream), "p95_stream")
    got = {(r.window_start, r.route, r.total, round(r.p95_seconds, 9)) for r in spark.table("p95_stream").collect()}
    q.stop()
    sub = log.where(F.to_date("completed_at").isin(days[:6]))
    batch = {(r.window_start, r.route, r.total, round(r.p95_seconds, 9))
             for r in telemetry.histogram_quantile(sub).collect()}
    last = sub.agg(F.max("completed_at")).first()[0]
    closed = {b for b in batch if b[0] + dt.timedelta(minutes=5) <= last - dt.timedelta(minutes=10)}
    assert got and got <= batch and closed <= got


def test_tail_ends_successful_jobs_and_times_out_idle_ones(spark):
    import datetime as dt

    t = dt.datetime(2026, 7, 29, 12, 0, 0)
    batches = [[("J1", "E1", t, "succeeded"), ("J2", "E2", t, "succeeded"), ("J3", "E3", t, "succeeded")],
               [("J1", "E4", t + dt.timedelta(seconds=30), "completed"),
                ("J2", "E5", t + dt.timedelta(seconds=30), "completed_with_errors")],
               [("J9", "E6", t + dt.timedelta(minutes=20), "succeeded")],
               [("J9", "E7", t + dt.timedelta(minutes=21), "failed")]]
    src = tempfile.mkdtemp(prefix="tail-")
    schema = "job_id string, event_id string, occurred_at timestamp, status string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b={i}")
        os.utime(f"{src}/b={i}", (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = _run_memory(tstream.tail_job_events(stream), "tail_more")
    out = {(r.job_id, r.event_id, r.status, r.kind) for r in spark.table("tail_more").collect()}
    q.stop()
    assert {o for o in out if o[3] != "event"} == {
        ("J1", None, "completed", "completed"), ("J2", None, "completed_with_errors", "completed"),
        ("J3", None, "still_running", "timeout"), ("J9", None, "failed", "completed")}
    assert sum(o[3] == "event" for o in out) == 7


def test_gauge_has_idle_instants(spark):
    import datetime as dt

    t = dt.datetime(2026, 7, 29, 23, 59, 58)
    rows = [(t + dt.timedelta(seconds=8), 7_000_000), (t + dt.timedelta(seconds=40), 1_000_000),
            (t + dt.timedelta(seconds=44), 9_000_000)]
    log = spark.createDataFrame(rows, "completed_at timestamp, duration_us long")
    got = {r.sampled_at: r.in_progress for r in telemetry.requests_in_progress(log).collect()}
    first = dt.datetime(2026, 7, 30)
    want = {first + dt.timedelta(seconds=s): n
            for s, n in ((0, 1), (5, 1), (10, 0), (15, 0), (20, 0), (25, 0), (30, 0), (35, 1), (40, 1))}
    assert got == want


def test_gauge_stream_closed_instants_equal_batch(spark):
    import datetime as dt

    t = dt.datetime(2026, 7, 29, 23, 0, 0)
    days = [[(t + dt.timedelta(seconds=37 * i + 1800 * b), (i * 7919 % 400) * 1_000_000 + 1) for i in range(25)] for b in range(3)]
    days.append([(t + dt.timedelta(hours=4), 2_000_000)])  # idle for more than an hour before
    days.append([(t + dt.timedelta(hours=5), 1_000_000)])
    schema = "completed_at timestamp, duration_us long"
    src = tempfile.mkdtemp(prefix="gauge-")
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{src}/b={i}")
        os.utime(f"{src}/b={i}", (1_700_000_000 + i,) * 2)
        for f in os.listdir(f"{src}/b={i}"):
            os.utime(f"{src}/b={i}/{f}", (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{src}/*")
    q = _run_memory(tstream.requests_in_progress_stream(stream), "gauge_stream")
    rows = spark.table("gauge_stream").collect()
    q.stop()
    got = {r.sampled_at: r.in_progress for r in rows}
    every = spark.createDataFrame([r for d in days for r in d], schema)
    batch = {r.sampled_at: r.in_progress for r in telemetry.requests_in_progress(every).collect()}
    assert len(got) == len(rows) > 1000
    closed = t + dt.timedelta(hours=5) - dt.timedelta(minutes=20)
    want = {k: v for k, v in batch.items() if k < closed}
    assert want and {k: v for k, v in got.items() if k in batch} == {k: batch[k] for k in got if k in batch}
    assert set(want) <= set(got) and sum(v == 0 for v in want.values()) > 500 and max(want.values()) > 3


def test_a_batch_reads_the_keys_of_its_own_references_only(spark):
    inbox, out = tempfile.mkdtemp(prefix="k-inbox-"), tempfile.mkdtemp(prefix="k-out-")
    head = b"snapshot_ref,as_of,partner_sku,depot,case_count,units_per_case\n"
    line = "{},2026-07-29T15:00:00Z,B-IP16-256-BLK,B-LAX-01,{}.000,12.000\n"
    import_stream.prepare_output(spark, out)

    def batch(n, refs):
        folder = f"{inbox}/{n}"
        _deliver(folder, SUP_B, "f.csv", head + "".join(line.format(r, n + 1) for r in refs).encode())
        files = spark.read.format("binaryFile").schema(import_stream.BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
        import_stream.process_batch(files, n, out, *_maps(spark))
        return spark.read.parquet(f"{out}/snapshots/batch_id={n}").count()

    def scanned(n, refs):
        feed = spark.createDataFrame([(SUP_B, r) for r in refs], "supplier_id string, source_reference string")
        found = import_stream.known_keys(spark, out, n, feed)
        return found.count()

    for n in range(3):
        assert batch(n, [f"R{n}-{i}" for i in range(6)]) == 6
    asked = ["R1-0", "R1-5", "new"]
    assert scanned(2, asked) == 2 and scanned(3, asked) == 2 and scanned(1, asked) == 0
    import_stream.compact_keys(spark, out, 2)
    assert import_stream._generation(spark, out, 3) == 2 and import_stream._generation(spark, out, 1) is None
    assert scanned(3, asked) == 2 and scanned(3, ["R2-1"]) == 1 and scanned(1, ["R0-0"]) == 1
    assert batch(3, ["R0-0", "R1-3", "R2-5", "R3-0"]) == 1  # the others came before, two of them in compacted batches
    assert import_stream._index(spark, out, 4).count() == 19
