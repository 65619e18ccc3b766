"""Driver contract: entry() smoke and registry consistency."""

import __spark_entry__ as E
from skuflow.plans import catalog

ROWS_ONLY = {"shortage_quantiles_approx", "source_partition_inventory"}


def test_entry_runs_flagship(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == [
        "event_date", "severity", "row_count", "projected_shortage_quantity", "mean_absolute_error"]
    assert df.count() > 0


def test_every_query_has_an_oracle_unless_rows_only():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY
    assert len(q) >= 111
    assert set(q) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
