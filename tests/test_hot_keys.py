"""One key with a large share of all rows: lifecycle (J1-J3) and as-of lookups (D14) against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skuflow.operators import lifecycle, mappings

TYPES = ["picked_up", "in_transit", "delayed", "delivered", "cancelled", "unheard_of"]
EVENTS = "arrival_seq long, shipment_id string, external_event_id string, event_type string, match_status string, note string"


def plain_verdicts(rows):
    """Each shipment's events one after the other."""
    out, state = [], {}
    for seq, ship, eid, kind, match, _ in sorted(rows):
        if match != "matched":
            out.append((seq, match, None))
            continue
        status, accepted = state.setdefault(ship, ["planned", set()])
        after = lifecycle.status_after_event(status, kind)
        if eid in accepted:
            out.append((seq, "duplicate", status))
        elif after is None:
            out.append((seq, "illegal_transition", status))
        else:
            state[ship][0] = after
            accepted.add(eid)
            out.append((seq, "accepted", after))
    return out


def events(rng, n, ids):
    rows = []
    for seq in range(n):
        ship = "HOT" if rng.random() < 0.5 else f"S{rng.randint(0, 40)}"
        match = rng.choice(["matched"] * 9 + ["not_found"])
        kind = rng.choice(TYPES[1:3] * 12 + TYPES) if ship == "HOT" else rng.choice(TYPES)
        rows.append((seq, ship if match == "matched" else None, f"E{rng.randint(0, ids)}", kind, match, "n"))
    return rows


@pytest.mark.parametrize(("partitions", "ids"), [(1, 60), (7, 40), (23, 15), (23, 4000)])
def test_lifecycle_of_a_shipment_with_half_of_all_events(spark, partitions, ids):
    # Without an end state in it, the hot shipment goes on to change its status through all partitions.
    rows = [r if r[1] != "HOT" or r[3] not in ("delivered", "cancelled") else (*r[:3], "in_transit", *r[4:])
            for r in events(random.Random(partitions + ids), 1500, ids)]
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = lifecycle.fold_events(df, partitions=partitions)
    assert got.columns == [*df.columns, "verdict", "status_after"]
    found = sorted((r.arrival_seq, r.verdict, r.status_after) for r in got.collect())
    assert found == sorted(plain_verdicts(rows))
    assert sum(v == "duplicate" for _, v, _ in found) > 20
    if partitions > 1:
        spread = got.where("shipment_id = 'HOT'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > partitions / 4


def test_a_refused_id_may_be_retried_in_a_later_partition(spark):
    rows = [(0, "A", "x", "delivered", "matched", ""), (1, "A", "y", "picked_up", "matched", "")]
    rows += [(i, "A", "y", "picked_up", "matched", "") for i in range(2, 40)]
    rows += [(40, "A", "x", "delivered", "matched", ""), (41, "A", "x", "delivered", "matched", ""), (42, "A", "z", "delayed", "matched", "")]
    df = spark.createDataFrame(rows, EVENTS)
    for n in (1, 6, 40):
        got = lifecycle.fold_events(df, partitions=n).collect()
        assert sorted((r.arrival_seq, r.verdict, r.status_after) for r in got) == plain_verdicts(rows)


def test_lifecycle_of_no_events(spark):
    none = lifecycle.fold_events(spark.createDataFrame([], EVENTS))
    assert none.count() == 0 and none.columns[-2:] == ["verdict", "status_after"]
    lost = spark.createDataFrame([(1, None, "x", "picked_up", "ambiguous", "")], EVENTS)
    assert [r.verdict for r in lifecycle.fold_events(lost).collect()] == ["ambiguous"]


@pytest.mark.parametrize("partitions", [1, 9, 31])
def test_as_of_with_a_key_that_holds_a_third_of_both_sides(spark, partitions):
    rng = random.Random(partitions)
    t0 = dt.datetime(2024, 1, 1)
    instant = lambda: t0 + dt.timedelta(seconds=rng.randint(0, 400))
    key = lambda: rng.choice(["hot", "hot", *(f"k{i}" for i in range(4))])
    upserts = [(i, key(), instant(), f"v{i}", None if i % 9 == 0 else i) for i in range(250)]
    facts = [(i, rng.choice([key(), "unknown", None]), None if i % 50 == 0 else instant(), float(i)) for i in range(600)]
    log = spark.createDataFrame(upserts, "n long, k string, ts timestamp, label string, amount int").repartition(4)
    asked = spark.createDataFrame(facts, "id long, k string, at timestamp, x double").repartition(4)
    history = mappings.intervals(log, ["k"], "ts", ["ts", "n"])
    got = mappings.as_of(asked, history, ["k"], "at", ["label", "amount"], partitions)
    assert got.columns == ["id", "k", "at", "x", "label", "amount"]
    assert [f.dataType for f in got.schema] == [f.dataType for f in [*asked.schema, log.schema["label"], log.schema["amount"]]]
    want = []
    for i, k, at, x in facts:
        before = [(ts, n, label, amount) for n, kk, ts, label, amount in upserts if k == kk and at is not None and ts <= at]
        want.append((i, k, at, x, *(max(before)[2:] if before else (None, None))))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want


def test_as_of_has_no_join(spark):
    log = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "n long, k string, ts timestamp")
    history = mappings.intervals(log, ["k"], "ts", ["ts"])
    found = mappings.as_of(log.withColumnRenamed("ts", "at"), history.withColumnRenamed("n", "m"), ["k"], "at", ["m"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and [r.m for r in found.collect()] == [1]


def test_deep_pages_equal_the_plain_order(spark):
    from skuflow.operators import reports

    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, n int").repartition(6)
    order = [F.col("k").asc_nulls_last(), F.col("n").desc(), F.col("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[2], r[0]))]
    for offset, limit in ((0, 50), (700, 10), (1990, 400), (2995, 50), (3000, 5), (9000, 5)):
        page = reports.paginate(df, order, offset, limit, shallow=100, partitions=16)
        assert page.columns == df.columns and [r.id for r in page.collect()] == want[offset:offset + limit]
    deep = reports.paginate(df, order, 2000, 20, shallow=100, partitions=30)
    assert len([r.id for r in deep.collect()]) == 20
    assert reports.paginate(df.limit(0), order, 500, 5, shallow=100).count() == 0
