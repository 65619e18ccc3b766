"""End-to-end pipeline runs (P1, P7) and sink read-backs."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skuflow.plans import pipeline
from skuflow.sinks import writers
from skuflow.sources import files, synthetic, views
from tests.conftest import SF001

DAY = dt.date(2026, 7, 29)


def _history(spark, inject_invalid=False):
    return synthetic.history_partitions(views.order_index(spark, SF001), DAY.isoformat(), DAY.isoformat(),
                                        inject_invalid=inject_invalid)


def test_pipeline_run_publish_and_verify(spark, tmp_out):
    raw_root = f"{tmp_out}/raw/history/inventory"
    files.write_history_csv(_history(spark), raw_root)
    inv = files.partition_inventory(spark, raw_root)
    assert files.require_objects(inv, DAY.isoformat()).first().object_count >= 1
    with pytest.raises(Exception, match="No raw inventory objects"):
        files.require_objects(inv, "1999-01-01").collect()
    prefix = f"{raw_root}/event_date={DAY.isoformat()}"
    history = files.scan_history_csv(spark, prefix, base_path=raw_root)
    assert history.select("event_date").distinct().first()[0] == DAY
    manifest = pipeline.run_pipeline(spark, history, DAY, "run/1 a", tmp_out, source_keys=["k"], method="approx")
    assert manifest["status"] == "succeeded" and manifest["input_rows"] == 1500
    assert manifest["thresholds"]["method"] == "positive shortage-ratio approximate p50 and p80"
    assert any(k.endswith(".parquet") for k in manifest["curated_keys"])
    checked = pipeline.verify_manifest(spark, tmp_out, DAY, "run/1 a")
    assert checked["run_id"] == "run/1 a"
    # curated read-back: all rows, partitioned by warehouse, event_date kept out of the files
    curated = spark.read.parquet(f"{tmp_out}/curated/inventory-risk/event_date={DAY}/run_id=run_1_a")
    assert curated.count() == 1500 and "event_date" not in curated.columns
    assert curated.select("warehouse_code").distinct().count() == 20
    summary = spark.read.parquet(f"{tmp_out}/curated/inventory-risk-summary/event_date={DAY}/run_id=run_1_a")
    assert summary.agg(F.sum("row_count")).first()[0] == 1500
    latest = writers.read_json_document(spark, f"{tmp_out}/manifests/inventory-risk/event_date={DAY}/latest.json")
    assert latest["run_id"] == "run/1 a"
    # a repeated run finds its manifest and leaves data and manifest alone
    again = pipeline.run_pipeline(spark, history.limit(10), DAY, "run/1 a", tmp_out)
    assert again == manifest
    assert spark.read.parquet(f"{tmp_out}/curated/inventory-risk/event_date={DAY}/run_id=run_1_a").count() == 1500
    # the catalogue reads what the run wrote
    listed = files.scan_manifests(spark, tmp_out).collect()
    assert [(r.manifest_key, r.status, r.spark_version) for r in listed] == [
        (f"manifests/inventory-risk/event_date={DAY}/run_id=run_1_a.json", "succeeded", spark.version)]
    assert listed[0].created_at == manifest["created_at"]


def test_rerun_after_an_interrupted_attempt_leaves_no_stale_warehouses(spark, tmp_out, monkeypatch):
    history = _history(spark)
    real = writers.write_json_document

    def lost(spark, doc, path, mode="errorifexists"):
        if "/manifests/" in path:
            raise OSError("lost")
        real(spark, doc, path, mode)

    monkeypatch.setattr(writers, "write_json_document", lost)
    with pytest.raises(OSError):
        pipeline.run_pipeline(spark, history, DAY, "r", tmp_out)
    monkeypatch.setattr(writers, "write_json_document", real)
    some = sorted(r[0] for r in history.select("warehouse_code").distinct().collect())[:3]
    manifest = pipeline.run_pipeline(spark, history.where(F.col("warehouse_code").isin(some)), DAY, "r", tmp_out)
    curated = spark.read.parquet(f"{tmp_out}/curated/inventory-risk/event_date={DAY}/run_id=r")
    assert sorted(r[0] for r in curated.select("warehouse_code").distinct().collect()) == some
    assert curated.count() == manifest["input_rows"]
    assert pipeline.verify_manifest(spark, tmp_out, DAY, "r") == manifest


def test_backfill_publishes_each_date_alone_and_finishes_on_retry(spark, tmp_out):
    good = synthetic.history_partitions(views.order_index(spark, SF001), "2026-07-27", "2026-07-29")
    bad_day = dt.date(2026, 7, 28)
    bad = good.withColumn("on_hand_quantity", F.when(F.col("event_date") == F.lit(bad_day), -1.0)
                          .otherwise(F.col("on_hand_quantity")))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        first = {r.event_date: (r.passed, r.published) for r in pipeline.run_backfill(spark, bad, "bf 1", tmp_out).collect()}
        days = sorted(first)
        assert [first[d] for d in days] == [(True, True), (False, False), (True, True)]
        before = pipeline.verify_manifest(spark, tmp_out, days[0], "bf 1")
        second = {r.event_date: r.published for r in pipeline.run_backfill(spark, good, "bf 1", tmp_out).collect()}
        assert all(second.values())
        assert pipeline.verify_manifest(spark, tmp_out, days[0], "bf 1") == before
        for d in days:
            m = pipeline.verify_manifest(spark, tmp_out, d, "bf 1")
            rows = spark.read.parquet(*[f"{tmp_out}/{k}" for k in m["curated_keys"]])
            assert rows.count() == m["input_rows"] == 1500
            latest = writers.read_json_document(spark, f"{tmp_out}/manifests/inventory-risk/event_date={d}/latest.json")
            assert latest == m
            report = writers.read_json_document(spark, f"{tmp_out}/quality/inventory/event_date={d}/run_id=bf_1.json")
            assert report["passed"]
        assert len(files.scan_manifests(spark, tmp_out).collect()) == 3
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_forecast_metrics_of_no_rows_fail(spark):
    from skuflow.operators import risk

    none = spark.createDataFrame([], "forecast_quantity double, actual_demand_quantity double")
    with pytest.raises(Exception, match="at least one row"):
        risk.forecast_metrics(none).collect()


def test_pipeline_gate_failure_writes_report_only(spark, tmp_out):
    history = _history(spark, inject_invalid=True)
    with pytest.raises(RuntimeError, match="1 invalid rows and 0 duplicate keys"):
        pipeline.run_pipeline(spark, history, DAY, "bad", tmp_out)
    rep = writers.read_json_document(spark, f"{tmp_out}/quality/inventory/event_date={DAY}/run_id=bad.json")
    assert (rep["input_rows"], rep["invalid_rows"], rep["passed"]) == (1501, 1, False)
    assert not os.path.exists(f"{tmp_out}/manifests/inventory-risk/event_date={DAY}/run_id=bad.json")


def test_backfill_per_date_thresholds(spark, tmp_out):
    hist = synthetic.history_partitions(views.order_index(spark, SF001), "2026-07-27", "2026-07-29")
    reports, curated, thresholds, summary = pipeline.backfill(hist)
    assert reports.where("passed").count() == 3
    assert thresholds.count() == 3
    assert curated.count() == 4500


def test_csv_bad_cells_become_null(spark, tmp_out):
    p = f"{tmp_out}/h/event_date=2026-07-29"
    os.makedirs(p)
    with open(f"{p}/a.csv", "w") as fh:
        fh.write("event_date,supplier_code,product_sku,warehouse_code,on_hand_quantity,reserved_quantity,"
                 "inbound_quantity,forecast_quantity,actual_demand_quantity\n"
                 "2026-07-29,S,P,W,abc,1,2,3,4\n")
    r = files.scan_history_csv(spark, p).first()
    assert r.on_hand_quantity is None and r.reserved_quantity == 1.0


def test_raw_content_addressed_and_payload_verification(spark, tmp_out):
    t = dt.datetime(2026, 7, 29, 12)
    payloads = spark.createDataFrame([
        ("supplier_b_csv", bytearray(b"a,b\n1,2\n"), t), ("supplier_b_csv", bytearray(b"a,b\n1,2\n"), t),
        ("supplier_a_json", bytearray(b'{"x": 1}'), t),
    ], "source_type string, content binary, observed_at timestamp")
    stored = writers.write_raw_content_addressed(payloads, f"{tmp_out}/raw/inventory")
    keys = sorted(r.object_key for r in stored.collect())
    h = hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    assert f"raw/inventory/source=supplier_b_csv/ingest_date=2026-07-29/{h}.csv" in keys and len(keys) == 2
    back = spark.read.parquet(f"{tmp_out}/raw/inventory")
    assert back.where(F.length("content") == F.col("stored_length")).count() == 2
    writers.write_raw_content_addressed(payloads, f"{tmp_out}/raw/inventory")
    assert spark.read.parquet(f"{tmp_out}/raw/inventory").count() == 2
    # Files on disk joined to jobs and checked
    d = f"{tmp_out}/payloads"
    os.makedirs(d)
    for name, body in (("good.csv", b"ok"), ("tampered.csv", b"changed")):
        with open(f"{d}/{name}", "wb") as fh:
            fh.write(body)
    jobs = spark.createDataFrame([
        ("J1", f"file:{d}/good.csv", hashlib.sha256(b"ok").hexdigest()),
        ("J2", f"file:{d}/tampered.csv", hashlib.sha256(b"original").hexdigest()),
        ("J3", f"file:{d}/missing.csv", "00"),
    ], "job_id string, payload_path string, content_sha256 string")
    got = {r.job_id: r.payload_status for r in files.verified_payloads(spark, jobs, d).collect()}
    assert got == {"J1": "ok", "J2": "checksum_mismatch", "J3": "missing"}
    read = files.payload_contents(spark, files.verified_payloads(spark, jobs, d), d).collect()
    assert [(r.job_id, bytes(r.content)) for r in read] == [("J1", b"ok")]


def test_analytics_run_and_operation_events_sinks(spark, tmp_out):
    header = spark.createDataFrame([("R1", "stockout_risk", "numpy", 42, 10)],
                                   "run_id string, run_type string, engine string, dataset_seed long, input_rows int")
    details = spark.createDataFrame([("R1", i, float(i)) for i in range(10)],
                                    "run_id string, record_index long, value double")
    writers.write_analytics_run(header, details, tmp_out)
    assert spark.read.parquet(f"{tmp_out}/analytics_details").where("run_id = 'R1'").count() == 10
    ev = spark.createDataFrame([("imports", "queued", "succeeded", "{}")],
                               "component string, stage string, status string, details string")
    writers.append_operation_events(ev, f"{tmp_out}/events")
    writers.append_operation_events(ev, f"{tmp_out}/events")
    assert spark.read.parquet(f"{tmp_out}/events").count() == 2


def test_repeated_runs_and_stages_are_stored_once(spark, tmp_out):
    header = lambda run, n: spark.createDataFrame([(run, n)], "run_id string, input_rows int")
    details = lambda run, n: spark.createDataFrame([(run, i, float(i)) for i in range(n)], "run_id string, record_index long, value double")
    for run, n in (("R1", 10), ("R2", 5), ("R1", 8)):  # the third is the first run again
        writers.write_analytics_run(header(run, n), details(run, n), tmp_out)
    stored = {r.run_id: r["count"] for r in spark.read.parquet(f"{tmp_out}/analytics_details").groupBy("run_id").count().collect()}
    assert stored == {"R1": 8, "R2": 5} and spark.read.parquet(f"{tmp_out}/analytics_runs").count() == 2
    events = lambda *ids: spark.createDataFrame([(i, "imports", "done") for i in ids], "event_id string, component string, status string")
    for batch in (events("a", "b", "b"), events("b", "c"), events("a", "b", "c")):
        writers.append_operation_events(batch, f"{tmp_out}/audit")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_out}/audit").collect()) == ["a", "b", "c"]


def _jobs(spark, run) -> int:
    """Spark jobs that ``run`` starts."""
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_a_backfill_do_not_depend_on_its_dates(spark, tmp_out):
    def run(last, out):
        hist = synthetic.history_partitions(views.order_index(spark, SF001), "2026-07-27", last)
        return _jobs(spark, lambda: pipeline.run_backfill(spark, hist, "many", out))

    few, many = run("2026-07-28", f"{tmp_out}/few"), run("2026-08-04", f"{tmp_out}/many")
    assert many <= few + 2 and few > 3
    assert pipeline.latest_runs(spark, f"{tmp_out}/many").count() == 9


def test_an_interrupted_backfill_is_finished_by_the_next(spark, tmp_out, monkeypatch):
    hist = synthetic.history_partitions(views.order_index(spark, SF001), "2026-07-27", "2026-07-29")
    real = pipeline.commit
    monkeypatch.setattr(pipeline, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        pipeline.run_backfill(spark, hist, "r1", tmp_out)  # manifests are there, neither commits nor latest
    monkeypatch.setattr(pipeline, "commit", real)
    for _ in range(2):
        assert pipeline.run_backfill(spark, hist, "r1", tmp_out).where("published").count() == 3
    log = spark.read.parquet(f"{tmp_out}/{pipeline.COMMITS}")
    assert log.count() == 3 and log.select("manifest_key").distinct().count() == 3
    pipeline.run_backfill(spark, hist, "r2", tmp_out)
    newest = {str(r.event_date): (r.run_id, r.manifest_key) for r in pipeline.latest_runs(spark, tmp_out).collect()}
    assert len(newest) == 3 and {run for run, _ in newest.values()} == {"r2"}
    for day, (_, key) in newest.items():
        document = writers.read_json_document(spark, f"{tmp_out}/{key}")
        assert writers.read_json_document(spark, f"{tmp_out}/{pipeline.MANIFESTS}/event_date={day}/latest.json") == document
