"""Accepted records by two aggregates against the verdict of every record."""

import random

import pytest
from pyspark.sql import functions as F

from skuflow.operators import imports
from skuflow.sources import entities, views

FEED = ("import_job_id string, job_seq int, supplier_id string, source_reference string, source_row long, external_sku string, "
        "external_location string, source_unit string, units_per_source_unit decimal(18,3), on_hand_quantity decimal(18,3)")


@pytest.mark.parametrize("stored", [False, True])
def test_accepted_equals_verdicts(spark, stored):
    rng = random.Random(1)
    rows = []
    for i in range(900):  # half of all records have one source key
        supplier, ref, sku, place = (("S1", "R0", "A", "L0") if rng.random() < 0.5 else
                                     (rng.choice(["S1", "S2"]), f"R{rng.randint(0, 6)}", rng.choice("ABC"), f"L{rng.randint(0, 2)}"))
        job = rng.randint(1, 12)
        rows.append((f"J{job}", job, supplier, ref, i, sku, place, rng.choice(["EACH", "EACH", "CASE"]), None, None))
    feed = spark.createDataFrame(rows, FEED).repartition(4)
    pm = spark.createDataFrame([(s, k, f"P{k}", "EACH", None, 1, k != "C") for s in ("S1", "S2") for k in "ABC"],
                               "supplier_id string, external_sku string, product_id string, source_unit string, "
                               "units_per_source_unit decimal(18,3), version int, active boolean")
    wm = spark.createDataFrame([(s, f"L{i}", f"W{i}", 1, True) for s in ("S1", "S2") for i in range(2)],
                               "supplier_id string, external_location string, warehouse_id string, version int, active boolean")
    before = feed.where("external_sku = 'B' AND source_reference = 'R1'") if stored else None
    every = imports.verdicts(feed, pm, wm, before).where("accepted")
    found = imports.accepted(feed, pm, wm, before)
    columns = [c for c in found.columns if c in every.columns]
    assert {"source_row", "product_id", "warehouse_id", "_map_factor", "product_mapping_version"} <= set(columns)
    key = lambda r: r["source_row"]
    assert sorted(found.select(*columns).collect(), key=key) == sorted(every.select(*columns).collect(), key=key)
    assert found.count() > 20



def test_only_repeated_keys_are_kept_and_joined_back(spark):
    rows = [("J1", 1, "S1", f"R{i}", i, "A", "L0", "EACH", None, None) for i in range(50)]
    rows += [("J1", 1, "S1", "R1", 60, "A", "L0", "EACH", None, None), ("J2", 2, "S1", "R2", 61, "A", "L0", "EACH", None, None),
             ("J2", 2, "S1", "R3", None, "A", "L0", "EACH", None, None), ("J2", 2, "S1", None, 62, "A", "L0", "EACH", None, None),
             ("J2", None, "S1", "R4", 63, "A", "L0", "EACH", None, None), ("J1", 1, "S1", "R5", 5, "A", "L0", "EACH", None, None)]
    feed = spark.createDataFrame(rows, FEED).repartition(3)
    pm = spark.createDataFrame([("S1", "A", "P", "EACH", None, 1, True)],
                               "supplier_id string, external_sku string, product_id string, source_unit string, "
                               "units_per_source_unit decimal(18,3), version int, active boolean")
    wm = spark.createDataFrame([("S1", "L0", "W", 1, True)],
                               "supplier_id string, external_location string, warehouse_id string, version int, active boolean")
    kept = []

    def once(df):
        kept.append(df.count())
        return df

    v = imports.verdicts(feed, pm, wm, once=once).collect()
    assert kept and max(kept) <= 10  # and not one row for every record
    assert len(v) == 54  # records without a whole key, or without a job, have no verdict
    assert sorted(r.source_row for r in v if r.duplicate_in_file) == [60]
    assert sorted((r.source_reference, r.source_row) for r in v if r.already_imported) == [("R2", 61), ("R3", None)]
    assert [r.duplicate_in_file for r in v if r.source_row is None] == [None]
    assert sum(r.accepted for r in v) == 51  # row 5 came twice: neither is later than the other


def test_accepted_records_meet_their_mapping_in_one_shuffle(spark, tmp_out):
    """Dealt views have the rows of the plain ones, with pairs that come often or lack a part; what is accepted of
    them is found without a second shuffle of the records."""
    rows = [(i % 50 if i % 11 else None, i % 13 if i % 17 else None, i % 5 if i % 19 else None, i % 7 + 1, float(i % 9), 1.5 * i,
             0.05, "F" if i % 2 else "O", f"199{i % 6}-01-0{i % 9 + 1}") for i in range(600)] + [(None, None, None, 1, 1.0, 1.0, 0.1, "F", None)] * 3
    line = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                       "l_extendedprice double, l_discount double, l_linestatus string, l_shipdate string")
    line.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_out}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(5)], "s_suppkey long").write.parquet(f"{tmp_out}/supplier.parquet")

    def equal(a, b):
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    key = ["supplier_id", "external_sku"]
    feed, pm, wm = views.feed_records(spark, tmp_out), views.product_map(spark, tmp_out), views.warehouse_map(spark, tmp_out)
    equal(views.feed_records(spark, tmp_out, key), feed)
    equal(views.product_map(spark, tmp_out, dealt=True), pm)
    equal(entities.order_lines(spark, tmp_out, ["order_id"]), entities.order_lines(spark, tmp_out))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = imports.accepted(views.feed_records(spark, tmp_out, key), views.product_map(spark, tmp_out, dealt=True), wm)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Two by what is read; then the locations, and the accepted records that ask for theirs.
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ENSURE_REQUIREMENTS") == 2, plan
    plain = imports.accepted(feed, pm, wm)
    shown = [c for c in found.columns if c != "observed_at"]
    equal(found.select(*shown), plain.select(*shown))
    assert found.count() > 20
