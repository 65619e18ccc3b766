"""Audits on small tables against plain counts, and the shape of their plan."""

import re

from pyspark.sql import functions as F

from skuflow.operators import audits
from skuflow.plans import q_audits


def test_every_kind_of_rule_against_plain_counts(spark):
    parents = [("p1", "x"), ("p2", "y"), ("p2", "y"), (None, "z")]
    children = [(1, "p1", "a", "bc", 5), (2, "p9", "ab", "c", -1), (3, None, "ab", "c", None), (4, "p9", None, "c", -2),
                (5, "p2", None, "c", 0), (6, None, "ab", "c", 3)] + [(i, "p1", f"k{i}", "", 1) for i in range(100, 400)]
    tables = {"parent": spark.createDataFrame(parents, "id string, v string"),
              "child": spark.createDataFrame(children, "n long, parent_id string, a string, b string, q int").repartition(5)}
    rules = audits.Rules(
        {"child": {("check", "q_positive"): "q > 0", ("enum", "b_enum"): "b IN ('c', '')", ("length", "a_length"): "length(a) <= 2"}},
        [("parent", "id_unique", ["id"]), ("child", "ab_unique", ["a", "b"]), ("child", "n_unique", ["n"])],
        [("child", "parent_fk", "parent_id", "parent", "id"), ("parent", "self_fk", "v", "parent", "id")])
    got = {(r.audit, r.table_name, r.rule): r.violations for r in audits.violations(spark, rules, tables.__getitem__).collect()}
    assert got == {("check", "child", "q_positive"): 3, ("enum", "child", "b_enum"): 1, ("length", "child", "a_length"): 300,
                   ("unique", "parent", "id_unique"): 1, ("unique", "child", "ab_unique"): 1, ("unique", "child", "n_unique"): 0,
                   ("foreign_key", "child", "parent_fk"): 2, ("foreign_key", "parent", "self_fk"): 4}


def test_empty_tables_break_nothing(spark):
    none = {"t": spark.createDataFrame([], "id string, q int")}
    rules = audits.Rules({"t": {("check", "q"): "q > 0"}}, [("t", "id_unique", ["id"])], [("t", "fk", "id", "t", "id")])
    assert [r.violations for r in audits.violations(spark, rules, none.__getitem__).collect()] == [0, 0, 0]


def test_each_table_is_read_once_and_keys_meet_in_one_exchange(spark):
    """With the declared rules over plain tables: no join but that of the rule list, one exchange by key."""
    rules = audits.Rules({t: q_audits._row_rules(t, ("check", "enum", "length")) for t in q_audits.TABLE_NAMES},
                         q_audits.UNIQUES, q_audits.FOREIGN_KEYS)

    def table(name):
        columns = q_audits._columns(name)
        return spark.range(10).select(*[F.when(F.col("id") > 3, F.col("id")).cast("string").alias(c) for c in columns])

    found = audits.violations(spark, rules, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Range \(", plan)) == len(rules.tables()) == len(q_audits.TABLE_NAMES) + len(
        {f[3] for f in q_audits.FOREIGN_KEYS} - set(q_audits.TABLE_NAMES))
    assert plan.count("Exchange hashpartitioning(scope") == 2 and plan.count("SortMergeJoin") == 0
    assert plan.count("BroadcastHashJoin") == 1
    by_rule = {(r.audit, r.table_name, r.rule): r.violations for r in found.collect()}
    assert len(by_rule) == 118 and all(v == 0 for (audit, *_), v in by_rule.items() if audit in ("unique", "foreign_key"))


def test_audits_read_the_columns_of_their_families(spark):
    unique = q_audits.Tables(spark, "/root/testdata/sf0.001", ("unique",))
    assert unique["purchase_order_lines"].columns == ["line_number", "order_id", "product_id"]
    kept = unique["inventory_snapshots"]
    assert "import_job_id" not in kept.columns and {"source_reference", "warehouse_id", "job_seq"} <= set(kept.columns)


def test_entries_carry_scopes_as_numbers_and_are_generated_code(spark):
    rules = audits.Rules({"t": {("check", "n_positive"): "n > 0"}}, [("t", "n_unique", ["n"])], [("t", "p_fk", "p", "p", "id")])
    tables = {"t": spark.createDataFrame([(1, "a"), (1, "b"), (-1, None)], "n int, p string"),
              "p": spark.createDataFrame([("a",)], "id string")}
    found = audits.violations(spark, rules, tables.__getitem__)
    assert sorted((r.audit, r.table_name, r.rule, r.violations) for r in found.collect()) == [
        ("check", "t", "n_positive", 1), ("foreign_key", "t", "p_fk", 1), ("unique", "t", "n_unique", 1)]
    assert dict(rules.listed(spark).dtypes)["scope"] == "int"
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_unique_keys_of_dealt_rows_are_counted_where_they_are(spark):
    rows = [(i % 40, f"x{i % 7}" if i % 9 else None) for i in range(300)] + [(None, "x1"), (None, "x1")]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5, "a")
    unique = [("t", "ab_unique", ["a", "b"]), ("t", "b_unique", ["b"])]
    plain, dealt = (audits.Rules({}, unique, [], by) for by in (None, {"t": ["a"]}))
    assert dealt.together("t") == {"ab_unique": "_n_ab_unique"} and plain.together("t") == {}
    found = [audits.violations(spark, rules, {"t": df}.__getitem__) for rules in (plain, dealt)]
    groups = len({r for r in rows if None not in r and rows.count(r) > 1})
    assert [sorted((r.rule, r.violations) for r in f.collect()) for f in found] == [[("ab_unique", groups), ("b_unique", 7)]] * 2
    plan = found[1]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(a") == 1 and plan.count("Exchange hashpartitioning(scope") == 2


def test_audited_tables_of_line_items_come_dealt(spark):
    """Numbered and mapped rows are shuffled once, as they are read; their declared keys hold what they are dealt by."""
    tables = q_audits.Tables(spark, "/root/testdata/sf0.001", ("unique",))
    for name in ("purchase_order_lines", "supplier_product_mappings"):
        rules = audits.Rules({}, [u for u in q_audits.UNIQUES if u[0] == name], [], q_audits.DEALT)
        assert set(rules.together(name)) == {rule for _, rule, _ in rules.unique}
        plan = rules.counted(name, tables[name])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan, plan
