"""Declared-constraint audits as one Spark job.

The relational model declares CHECK, UNIQUE, FOREIGN KEY, enum and length
constraints. Spark enforces none of them, so each becomes an audit that counts
what breaks it. Every table is read once, whatever number of rules it has part
in; a row gives one entry ``(scope, key, slot)`` for

* each CHECK, enum or length rule that it breaks (a rule on NULL passes, as in SQL);
* each UNIQUE rule: scope is the rule, key its columns (rows with a NULL key are
  exempt, as UNIQUE admits NULLs);
* each FOREIGN KEY of its own: scope is the parent's column, key the reference, slot
  the rule, so that all children of a parent meet in one place;
* each column that other tables refer to: the same scope, and the key is known.

One aggregate by (scope, key) over the entries of all tables then says how often
a unique key occurs and whether a reference has its parent: no joins, and one
exchange, before which a key with very many rows is combined to one entry a task.
Where a table's rows come dealt by columns of a unique key, as behind a window
over its parent, all rows of the key are in one task already: they are counted
there, and only the rows of repeated keys give entries.
A scope is a number in the entries, as each of them carries it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ENTRY = "struct<scope:int,key:string,slot:int,parent:boolean>"


def _key(columns: list[str]) -> Column:
    """The values as one string, each with its length in front."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[part for t in text for part in (F.char_length(t).cast("string"), F.lit(":"), t)])


def _entry(scope: int, key: Column, slot: int = 0, parent: bool = False) -> Column:
    return F.struct(F.lit(scope).alias("scope"), key.alias("key"), F.lit(slot).alias("slot"), F.lit(parent).alias("parent"))


class Rules:
    """Rules to audit: ``row``: table -> {(family, rule): SQL condition}; ``unique``: (table, rule, columns);
    ``foreign``: (table, rule, column, parent table, parent column); ``dealt``: table -> columns by which its rows
    are partitioned as they come."""

    def __init__(self, row: dict[str, dict[tuple[str, str], str]], unique: list[tuple[str, str, list[str]]],
                 foreign: list[tuple[str, str, str, str, str]], dealt: dict[str, list[str]] | None = None):
        self.row, self.unique, self.foreign, self.dealt = row, unique, foreign, dealt or {}
        by_parent: dict[str, list] = {}
        for rule in foreign:
            by_parent.setdefault(f"{rule[3]}.{rule[4]}", []).append(rule)
        self.by_parent = by_parent
        self.slots = max([1, *map(len, by_parent.values())])
        self.scope = {name: i for i, name in enumerate(dict.fromkeys(r[0] for r in self._rows()))}

    def tables(self) -> list[str]:
        named = {t for t, rules in self.row.items() if rules} | {u[0] for u in self.unique}
        return sorted(named | {f[0] for f in self.foreign} | {f[3] for f in self.foreign})

    def entries(self, table: str) -> list[Column]:
        """What a row of the table adds; NULL for nothing."""
        out = [F.when(~F.expr(cond), _entry(self.scope[f"{family}|{table}|{rule}"], F.lit("")))
               for (family, rule), cond in self.row.get(table, {}).items()]
        together = self.together(table)
        for t, rule, keys in self.unique:
            if t == table:
                given = _key(keys).isNotNull() & (F.col(together[rule]) > 1) if rule in together else _key(keys).isNotNull()
                out.append(F.when(given, _entry(self.scope[f"unique|{table}|{rule}"], _key(keys))))
        for scope, rules in self.by_parent.items():
            out += [F.when(F.col(column).isNotNull(), _entry(self.scope[scope], _key([column]), slot))
                    for slot, (t, _, column, _, _) in enumerate(rules) if t == table]
            if rules[0][3] == table:
                known = _key([rules[0][4]])
                out.append(F.when(known.isNotNull(), _entry(self.scope[scope], known, -1, True)))
        return out

    def together(self, table: str) -> dict[str, str]:
        """Unique rules of the table whose keys' rows come in one task -> the column of the rows per key."""
        by = self.dealt.get(table)
        return {rule: f"_n_{rule}" for t, rule, keys in self.unique if t == table and by and set(by) <= set(keys)}

    def counted(self, table: str, df: DataFrame) -> DataFrame:
        """``df`` with the rows per key of the rules ``together``."""
        keys = {rule: keys for t, rule, keys in self.unique if t == table}
        return df.withColumns({n: F.count(F.lit(1)).over(Window.partitionBy(*keys[rule]))
                               for rule, n in self.together(table).items()})

    def _rows(self) -> list[tuple]:
        rows = [(f"{family}|{t}|{rule}", 0, family, t, rule) for t, rules in self.row.items() for family, rule in rules]
        rows += [(f"unique|{t}|{rule}", 0, "unique", t, rule) for t, rule, _ in self.unique]
        rows += [(scope, slot, "foreign_key", t, rule) for scope, rules in self.by_parent.items()
                 for slot, (t, rule, *_) in enumerate(rules)]
        return rows

    def listed(self, spark: SparkSession) -> DataFrame:
        """``(scope, slot, audit, table_name, rule)``: every rule once."""
        return spark.createDataFrame([(self.scope[s], *r) for s, *r in self._rows()],
                                     "scope int, slot int, audit string, table_name string, rule string")


def violations(spark: SparkSession, rules: Rules, table) -> DataFrame:
    """``(audit, table_name, rule, violations)``: rows that break a row rule, key groups with more than one
    row, references without a parent. ``table``: name -> DataFrame."""
    parts = []
    for name in rules.tables():
        # Exploded whole: a filter of the array would evaluate the entries row by row without generated code.
        found = F.explode(F.array(*[e.cast(_ENTRY) for e in rules.entries(name)]))
        parts.append(rules.counted(name, table(name)).select(found.alias("e")).where("e IS NOT NULL").select("e.*"))
    entries = reduce(lambda a, b: a.unionByName(b), parts)
    keys = entries.groupBy("scope", "key").agg(
        F.bool_or("parent").alias("known"), *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(rules.slots)])
    # A row rule or unique rule has a scope of its own; the slots of a parent's scope are its children's rules.
    scopes = keys.groupBy("scope").agg(
        F.sum("n0").alias("rows"), F.count_if(F.col("n0") > 1).alias("repeated"),
        F.array(*[F.sum(F.when(~F.col("known"), F.col(f"n{i}")).otherwise(0)) for i in range(rules.slots)]).alias("orphans"))
    count = (F.when(F.col("audit") == "unique", F.col("repeated"))
             .when(F.col("audit") == "foreign_key", F.get("orphans", "slot")).otherwise(F.col("rows")))
    # The rules are a fixed list, the counts as many at most.
    return rules.listed(spark).join(F.broadcast(scopes), "scope", "left").select(
        "audit", "table_name", "rule", F.coalesce(count, F.lit(0).cast("long")).alias("violations"))
