"""Reconciliation in tasks of a bounded share of the input."""

import re

import pytest

from skuflow.operators import reconcile
from tests.conftest import SF001

SIDES = ("record_index long, supplier_code string, product_sku string, warehouse_code string, reported_quantity long",
         "record_index long, product_sku string, warehouse_code string, hub_quantity long")


def test_no_aggregate_holds_a_tasks_rows_before_the_shuffle(spark, tmp_out):
    supplier = spark.createDataFrame([(i, "S", f"K{i}", "W", i) for i in range(40)], SIDES[0])
    hub = spark.createDataFrame([(i, f"K{i}", "W", i - i % 2) for i in range(40)], SIDES[1])
    supplier.write.parquet(f"{tmp_out}/s")
    hub.write.parquet(f"{tmp_out}/h")
    supplier, hub = spark.read.parquet(f"{tmp_out}/s"), spark.read.parquet(f"{tmp_out}/h")
    found = reconcile.reconcile(supplier, hub)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION" in plan
    assert plan.index("Aggregate") < plan.index("Exchange") and "Aggregate" not in plan[plan.index("Exchange"):]
    assert sorted((r.record_index, r.matches) for r in found.collect()) == [(i, i % 2 == 0) for i in range(40)]
    equal = reconcile.outputs_equal(found, reconcile.reconcile(supplier, hub, "merge")).collect()[0]
    assert (equal.left_rows, equal.right_rows, equal.outputs_equal) == (40, 40, True)
    twice = reconcile.reconcile(supplier.unionByName(supplier.limit(1)), hub)
    with pytest.raises(Exception, match="matching keys"):
        twice.collect()


def test_tasks_grow_with_the_input(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet")
    few, many = (reconcile._spread(df, ["l_orderkey"], n)._jdf.queryExecution().executedPlan().toString() for n in (10**9, 1000))
    tasks = [int(re.search(r"hashpartitioning\(.*?, (\d+)\), REPARTITION", p)[1]) for p in (few, many)]
    assert tasks[0] == spark.sparkContext.defaultParallelism and tasks[1] > 5 * tasks[0]


def test_both_plans_and_their_comparison_shuffle_each_side_once(spark, tmp_out):
    rows = [(i, "S", f"K{i}", "W", i) for i in range(40)]
    supplier = spark.createDataFrame(rows, SIDES[0])
    hub = spark.createDataFrame([(i, k, w, i - i % 2) for i, _, k, w, _ in rows], SIDES[1])
    supplier.write.parquet(f"{tmp_out}/s")
    hub.write.parquet(f"{tmp_out}/h")
    supplier, hub = spark.read.parquet(f"{tmp_out}/s"), spark.read.parquet(f"{tmp_out}/h")
    plans = reconcile.both_plans(supplier, hub)
    equal = reconcile.outputs_equal(*plans)
    executed = equal._jdf.queryExecution().executedPlan()
    executed.executeCollect()
    plan = executed.toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"(?<!ReusedExchange )Exchange hashpartitioning\(", re.sub(r"ReusedExchange \[.*", "", plan))
    assert len(dealt) == 2 and plan.count("SortMergeJoin") == 1 and plan.count("ReusedExchange") == 2, plan
    assert equal.collect()[0].asDict() == {"left_rows": 40, "right_rows": 40, "left_only_rows": 0, "right_only_rows": 0,
                                           "outputs_equal": True}
    flat = lambda df: sorted((r._key.record_index, r.reported_quantity, r.hub_quantity, r.matches) for r in df.collect())
    assert flat(plans[0]) == flat(plans[1]) == [(i, i, i - i % 2, i % 2 == 0) for i in range(40)]


@pytest.mark.parametrize("fault", ["supplier twice", "hub twice", "no hub row", "no supplier row"])
def test_each_plan_of_both_fails_on_keys_that_do_not_match(spark, fault):
    rows = [(i, "S", f"K{i}", "W", i) for i in range(9)]
    supplier, hub = spark.createDataFrame(rows, SIDES[0]), spark.createDataFrame([(i, k, w, 1) for i, _, k, w, _ in rows], SIDES[1])
    if "twice" in fault:
        supplier, hub = (df.unionByName(df.where("record_index = 3")) if fault.startswith(side) else df
                         for side, df in (("supplier", supplier), ("hub", hub)))
    else:
        supplier, hub = (df.where("record_index <> 3") if side in fault else df for side, df in (("supplier", supplier), ("hub", hub)))
    for plan in reconcile.both_plans(supplier, hub):
        with pytest.raises(Exception, match="matching keys"):
            plan.collect()


def test_a_key_without_a_part_is_in_the_aggregate_and_in_no_join(spark):
    rows = [(1, "S", "K", "W", 5), (None, "S", "K", "W", 6), (2, "S", None, "W", 7)]
    supplier, hub = spark.createDataFrame(rows, SIDES[0]), spark.createDataFrame([(i, k, w, 5) for i, _, k, w, _ in rows], SIDES[1])
    found = reconcile.outputs_equal(*reconcile.both_plans(supplier, hub)).first()
    plain = reconcile.outputs_equal(reconcile.reconcile(supplier, hub), reconcile.reconcile(supplier, hub, "merge")).first()
    assert found == plain and (found.left_rows, found.right_rows, found.outputs_equal) == (3, 1, False)
