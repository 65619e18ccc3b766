"""Plan-shape checks: pruning and pushdown reach the scan; no pairwise products."""

import re

import pytest

from skuflow.plans import catalog
from skuflow.sources import views
from tests.conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[str]:
    """Columns each Parquet scan reads (its output list)."""
    return re.findall(r"FileScan parquet \[([^\]]*)\]", plan)


def test_history_scan_reads_only_needed_columns(spark):
    plan = _plan(catalog.queries()["severity_summary"](spark, SF001))
    schemas = [s for s in _read_schemas(plan) if "l_shipdate" in s]
    assert schemas, plan
    for s in schemas:
        assert "l_returnflag" not in s and "l_discount" not in s and "l_extendedprice" not in s


def test_filters_pushed_into_parquet(spark):
    plan = _plan(views.mapping_upserts(spark, SF001))
    assert re.search(r"PushedFilters: \[[^\]]*Not\(EqualTo\(event_type,purchase\)\)", plan), plan


@pytest.mark.parametrize("key", [
    "inventory_risk_pipeline", "backfill", "reconcile_inventory", "supplier_import", "carrier_stream",
    "snapshot_lineage", "request_rate_5m", "events_after_cursor", "engine_outputs_equal",
])
def test_no_cartesian_products(spark, key):
    plan = _plan(catalog.queries()[key](spark, SF001))
    assert "CartesianProduct" not in plan
    # Nested-loop joins only attach a one-row aggregate (broadcast build side).
    for m in re.finditer(r"BroadcastNestedLoopJoin (Build\w+), (\w+)", plan):
        assert m.group(2) == "Cross" and m.group(1) == "BuildRight"


def _scans(plan: str, column: str) -> int:
    """Parquet scans that read the column (reused exchanges count once)."""
    return sum(column in s for s in _read_schemas(plan))


def test_fact_tables_are_scanned_once_or_twice(spark):
    queries = catalog.queries()
    # The mapped records are stored, so the plan that is left reads no lineitem at all.
    assert _scans(_plan(queries["supplier_import"](spark, SF001)), "l_orderkey") == 0
    assert _scans(_plan(queries["inventory_risk_pipeline"](spark, SF001)), "l_orderkey") == 0
    # Judged events are kept; the plan that is left adds those without a shipment.
    assert _scans(_plan(queries["shipment_event_rejects"](spark, SF001)), "event_id") <= 1
    assert _scans(_plan(queries["hub_overview"](spark, SF001)), "l_orderkey") == 0


def _run_scans(df) -> int:
    """Scans that a run makes: those of the final adaptive plan, where a reused exchange is no scan."""
    executed = df._jdf.queryExecution().executedPlan()
    executed.executeCollect()
    return executed.toString().split("== Initial Plan ==")[0].count("FileScan")


def test_quantiles_read_their_rows_twice_and_the_pipeline_three_times(spark):
    queries = catalog.queries()
    assert _run_scans(queries["shortage_quantiles_exact"](spark, SF001)) == 2
    assert _run_scans(queries["duration_stats"](spark, SF001)) <= 3  # its counts per route are the third
    for key in ("inventory_risk_pipeline", "backfill"):  # of the stored history
        df = queries[key](spark, SF001)
        assert _plan(df).count("FileScan") <= 6 and _run_scans(df) == 3, key


def test_broadcast_strategy_broadcasts_a_small_hub_side(spark):
    plan = _plan(catalog.queries()["reconcile_strategy"](spark, SF001))
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("n", [0, 2])
def test_a_cursor_that_is_not_one_row_fails(spark, n):
    from skuflow.functions.frames import attach_scalars, exactly_one

    one = spark.range(5).where("id = 3").withColumnRenamed("id", "c")
    assert attach_scalars(spark.range(4), exactly_one(one, "cursor")).count() == 4
    with pytest.raises(Exception, match="one row expected"):
        attach_scalars(spark.range(4), exactly_one(spark.range(n).withColumnRenamed("id", "c"), "cursor")).collect()
