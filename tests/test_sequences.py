"""Skew-safe segmented scan equals the window formulation."""

import random

from skuflow.operators import mappings
from skuflow.operators.sequences import running_change_versions


def test_running_change_versions_match_window_with_hot_key(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = "HOT" if rng.random() < 0.5 else f"K{rng.randint(0, 40)}"
        attr = rng.choice(["a", "a", "a", "b", None])
        rows.append((key, i, attr, rng.randint(0, 2)))
    df = spark.createDataFrame(rows, "k string, seq long, attr string, n int")
    want = {(r.k, r.seq): r.version for r in mappings.versions(df, ["k"], ["attr", "n"], ["seq"], method="window").collect()}
    for parts in (1, 3, 7, 16):
        got = running_change_versions(df, ["k"], ["seq"], ["attr", "n"], partitions=parts)
        assert {(r.k, r.seq): r.version for r in got.collect()} == want


def test_skew_safe_row_numbers_match_window(spark):
    from skuflow.operators import reports

    rng = random.Random(5)
    rows = [("HOT" if rng.random() < 0.6 else f"P{rng.randint(0, 30)}", i, rng.randint(0, 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "parent string, seq long, t long")
    want = {(r.parent, r.seq): r.n for r in reports.sequence_numbers(df, ["parent"], ["t", "seq"], "n").collect()}
    got = reports.sequence_numbers(df, ["parent"], ["t", "seq"], "n", skew_safe=True)
    assert {(r.parent, r.seq): r.n for r in got.collect()} == want


def test_versions_hold_under_union_coalesce_and_repartition(spark):
    rows = [("K", i, str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, seq long, attr string")
    want = [(i, i + 1) for i in range(40)]

    def got(out):
        return sorted((r.seq, r.version) for r in out.select("seq", "version").collect())

    once = running_change_versions(df, ["k"], ["seq"], ["attr"], partitions=4)
    other = running_change_versions(df, ["k"], ["seq"], ["attr"], partitions=3)
    assert got(once.coalesce(1)) == want
    assert got(once.repartition(5)) == want
    assert got(other.unionByName(once)) == sorted(want * 2)
    assert got(once.unionByName(other).coalesce(2)) == sorted(want * 2)


def test_next_in_key_equals_lead(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from skuflow.operators.sequences import next_in_key

    rng = random.Random(7)
    rows = [("HOT" if rng.random() < 0.6 else f"K{rng.randint(0, 20)}", i, rng.randint(0, 10 ** 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = {r.seq: r.n for r in df.withColumn(
        "n", F.lead("ts").over(Window.partitionBy("k").orderBy("ts", "seq"))).collect()}
    for parts in (1, 5, 13):
        got = next_in_key(df, ["k"], ["ts", "seq"], "ts", "n", partitions=parts)
        assert {r.seq: r.n for r in got.coalesce(2).collect()} == want
