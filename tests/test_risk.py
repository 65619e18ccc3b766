"""Worked examples for availability, stockout scoring, thresholds and metrics."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skuflow.functions import scalars as X
from skuflow.operators import quality, risk
from skuflow.operators.quantiles import exact_quantiles

COLS = "record_index long, on_hand_quantity double, reserved_quantity double, inbound_quantity double, " \
       "forecast_quantity double, actual_demand_quantity double"


def test_available_quantity(spark):
    df = spark.createDataFrame([(120.0, 35.0), (10.0, 15.0), (-1.0, 0.0)], "a double, b double")
    rows = df.select(X.available_quantity("a", "b").alias("v"),
                     X.available_quantity_valid("a", "b").alias("ok")).collect()
    assert [r.v for r in rows[:2]] == [85.0, 0.0]
    assert [r.ok for r in rows] == [True, True, False]


def test_stockout_pair(spark):
    df = spark.createDataFrame([(0, 100.0, 20.0, 10.0, 120.0, 110.0), (1, 80.0, 10.0, 20.0, 50.0, 60.0)], COLS)
    curated, thr = risk.score(df, "exact")
    r = {x.record_index: x for x in curated.collect()}
    assert r[0].available_quantity == 80 and r[0].projected_ending_quantity == -30
    assert r[0].projected_shortage_quantity == 30 and r[0].shortage_ratio == 0.25
    assert r[0].severity == "low"
    assert r[1].projected_ending_quantity == 40 and r[1].shortage_ratio == 0 and r[1].severity == "none"
    t = thr.first()
    assert (t.low_to_medium, t.medium_to_high) == (0.25, 0.25)
    m = risk.forecast_metrics(df).first()
    assert m.mean_absolute_error == 10 and m.root_mean_squared_error == 10 and m.bias == 0
    assert m.weighted_absolute_percentage_error == pytest.approx(20 / 170)


def test_thresholds_empty_positive_set(spark):
    df = spark.createDataFrame([(0, 100.0, 0.0, 0.0, 10.0, 10.0)], COLS)
    curated, thr = risk.score(df, "exact")
    assert tuple(thr.first()) == (0.0, 0.0)
    assert curated.first().severity == "none"
    _, thr2 = risk.score(df, "approx")
    assert tuple(thr2.first()) == (0.0, 0.0)


def test_severity_counts_keeps_zero_levels(spark):
    df = spark.createDataFrame([(0, 100.0, 20.0, 10.0, 120.0, 110.0)], COLS)
    curated, _ = risk.score(df, "exact")
    counts = {r.severity: r.row_count for r in risk.severity_counts(curated).collect()}
    assert counts == {"none": 0, "low": 1, "medium": 0, "high": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 101, 5000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = random.Random(n)
    vals = [float(rng.choice([rng.random(), 0.5, 0.25, rng.randint(1, 9) / 10])) for _ in range(n)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    q = exact_quantiles(df, "x", [0.5, 0.8, 0.95], ["a", "b", "c"]).first()
    expected = np.quantile(np.array(vals), [0.5, 0.8, 0.95])
    assert [q.a, q.b, q.c] == pytest.approx(list(expected), rel=1e-12, abs=1e-12)
    grouped = {r.g: r for r in exact_quantiles(df, "x", [0.5, 0.8], ["a", "b"], ["g"]).collect()}
    for gk in set(i % 3 for i in range(n)):
        sub = np.array([v for i, v in enumerate(vals) if i % 3 == gk])
        e = np.quantile(sub, [0.5, 0.8])
        assert [grouped[gk].a, grouped[gk].b] == pytest.approx(list(e), rel=1e-12, abs=1e-12)


def test_exact_quantiles_hot_value(spark):
    # A third of all rows share one value: ties collapse before the window.
    vals = [0.5] * 3000 + [i / 6000 for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.5, 0.8], ["a", "b"]).first()
    assert [q.a, q.b] == pytest.approx(list(np.quantile(np.array(vals), [0.5, 0.8])))


def test_quality_report_and_gate(spark):
    d = dt.date(2026, 7, 29)
    rows = [(d, "S", "P", "W", 1.0, 0.0, 0.0, 1.0, 1.0),
            (d, "S", "P", "W", 1.0, 0.0, 0.0, 1.0, 1.0),
            (d, "S", " ", "W2", -1.0, 0.0, 0.0, 1.0, 1.0)]
    schema = ("event_date date, supplier_code string, product_sku string, warehouse_code string, "
              "on_hand_quantity double, reserved_quantity double, inbound_quantity double, "
              "forecast_quantity double, actual_demand_quantity double")
    df = spark.createDataFrame(rows, schema)
    rep = quality.quality_report(df).first()
    assert (rep.input_rows, rep.invalid_rows, rep.duplicate_keys, rep.passed) == (3, 1, 1, False)
    with pytest.raises(Exception, match="Data-quality gates failed"):
        quality.enforce_gate(df, quality.quality_report(df)).count()
    nan = spark.createDataFrame([(d, "S", "P", "W", float("nan"), 0.0, 0.0, 1.0, 1.0)], schema)
    assert quality.invalid_rows(nan).count() == 0  # NaN passes, as in the reference


def test_gate_passes_on_clean_history(spark):
    from skuflow.sources import views
    from tests.conftest import SF001

    rep = quality.quality_report(views.v_inv_clean(spark, SF001)).first()
    assert rep.passed and rep.duplicate_keys == 0
    assert views.v_inv_clean(spark, SF001).where(F.col("event_date").isNull()).count() == 0


def test_approx_thresholds_within_rank_error(spark):
    # E5: the GK element is within N / accuracy ranks of the exact quantile.
    from skuflow.operators.quantiles import approx_quantiles

    n = 20000
    df = spark.range(n).select((F.col("id") * 7919 % n / n).alias("x"))
    a = approx_quantiles(df, "x", [0.5, 0.8], ["p50", "p80"], accuracy=1000).first()
    xs = sorted((i * 7919 % n) / n for i in range(n))
    for value, p in ((a.p50, 0.5), (a.p80, 0.8)):
        rank = xs.index(value)
        assert abs(rank - p * n) <= n / 1000 + 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=300),
       st.sampled_from([0.0, 0.1, 0.5, 0.8, 0.95, 1.0]))
def test_exact_quantiles_property(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", [p], ["q"]).first().q
    assert got == pytest.approx(float(np.quantile(np.array(values), p)), rel=1e-9, abs=1e-9)
