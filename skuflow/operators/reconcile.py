"""Supplier-vs-hub reconciliation.

The reference validates a 1:1 join (``validate="one_to_one"``) and then checks
that both inputs matched completely. The default plan here does both in one
aggregation: both sides are tagged, unioned and grouped by the key once; per
key the side counts must be exactly (1, 1), otherwise the job fails in-plan,
and the side values form the joined row. That is a single shuffle and no second
validation pass. Keys occur once a side, so combining them before the shuffle
would only hold all rows of a task; they are spread first, over as many tasks
as the input's size asks for. Join-hint plans (sort-merge,
shuffle-hash, size-checked broadcast) remain available as strategies (K2) and
are validated by the rows per key on either side. Where the results of two
plans are compared, both sides are dealt by their key once, and neither the
plans nor the comparison shuffle rows again (``both_plans``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions import scalars as X
from skuflow.functions.frames import attach_scalars

KEYS = ["record_index", "product_sku", "warehouse_code"]
DEALT = "_key"  # the key as one column, of rows that are dealt by it
STRATEGIES = ("aggregate", "merge", "shuffle_hash", "broadcast")
MAX_TASKS = 20_000  # beyond, the estimate is no size of files
MISMATCH_MESSAGE = "Reconciliation inputs do not contain matching keys."


def _joined(supplier: DataFrame, hub: DataFrame, strategy: str = "merge") -> DataFrame:
    """The inner join by the caller's strategy. ``broadcast`` sends the hub side
    to every task where its size is known to be small, and falls back to
    ``merge`` beyond that."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported reconciliation strategy {strategy!r}")
    if strategy == "broadcast" and not _small(hub):
        strategy = "merge"
    return supplier.join(hub.hint(strategy), KEYS)


def _small(df: DataFrame, limit_bytes: int = 64 * 1024 * 1024) -> bool:
    """Optimizer size estimate of a plan (statistics only, no job)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit_bytes


def _tasks(dfs: list[DataFrame], task_bytes: int) -> int | None:
    """Tasks of a bounded share of the input (the optimizer's estimate from file sizes, several times less than
    in memory); None where there is no estimate."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in dfs)
    tasks = max(size // task_bytes + 1, dfs[0].sparkSession.sparkContext.defaultParallelism)
    return tasks if tasks <= MAX_TASKS else None


def _spread(df: DataFrame, keys: list[str], task_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Rows dealt by ``keys`` for the aggregate that follows, in tasks of a bounded share of the input; by the
    session's count where there is no estimate."""
    tasks = _tasks([df], task_bytes)
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def _dealt(supplier: DataFrame, hub: DataFrame, task_bytes: int = 4 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key as one column, which is equal to another also where both lack a part, dealt by it
    over equally many tasks (smaller ones: both plans sort their rows there at once). Plans over the two read the
    same shuffled rows."""
    tasks = _tasks([supplier, hub], task_bytes) or int(supplier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(df.select(F.struct(*KEYS).alias(DEALT), *[c for c in df.columns if c not in KEYS]).repartition(tasks, DEALT)
                 for df in (supplier, hub))


def _side_counts(supplier: DataFrame, hub: DataFrame) -> DataFrame:
    """Rows per key on either side, from one aggregate over the tagged keys."""
    tagged = supplier.select(*KEYS, F.lit(1).alias("_s"), F.lit(0).alias("_h")).unionByName(
        hub.select(*KEYS, F.lit(0).alias("_s"), F.lit(1).alias("_h")))
    return _spread(tagged, KEYS).groupBy(*KEYS).agg(F.sum("_s").alias("supplier_rows"), F.sum("_h").alias("hub_rows"))


def violations(supplier: DataFrame, hub: DataFrame) -> DataFrame:
    """Keys that break the 1:1 contract: duplicated on a side, or unmatched."""
    return _side_counts(supplier, hub).where((F.col("supplier_rows") != 1) | (F.col("hub_rows") != 1))


def _aggregate_join(supplier: DataFrame, hub: DataFrame, validate: bool) -> DataFrame:
    """The 1:1 join as one aggregation: both sides tagged, unioned and grouped
    by the key once. Per key the side counts must both be 1 (checked in-plan,
    row by row); the side values are then the joined row. One shuffle, no
    second pass."""
    keys = [DEALT] if DEALT in supplier.columns else KEYS
    s = supplier.select(*keys, "supplier_code", "reported_quantity",
                        F.lit(None).cast("bigint").alias("hub_quantity"), F.lit(1).alias("_side"))
    h = hub.select(*keys, F.lit(None).cast("string").alias("supplier_code"),
                   F.lit(None).cast("bigint").alias("reported_quantity"), "hub_quantity", F.lit(2).alias("_side"))
    tagged = s.unionByName(h)
    g = (tagged if keys == [DEALT] else _spread(tagged, KEYS)).groupBy(*keys).agg(
        F.count_if(F.col("_side") == 1).alias("_sn"), F.count_if(F.col("_side") == 2).alias("_hn"),
        F.max("supplier_code").alias("supplier_code"), F.max("reported_quantity").alias("reported_quantity"),
        F.max("hub_quantity").alias("hub_quantity"),
    )
    ok = (F.col("_sn") == 1) & (F.col("_hn") == 1)
    return g.where(_checked(ok) if validate else ok).drop("_sn", "_hn")


def _checked(ok: Column, kept: Column | None = None) -> Column:
    """``kept`` (or all) of the rows that are ``ok``; any other row fails the job."""
    return F.when(ok, F.lit(True) if kept is None else kept).otherwise(F.raise_error(F.lit(MISMATCH_MESSAGE)))


def _merge_dealt(supplier: DataFrame, hub: DataFrame, rows: DataFrame) -> DataFrame:
    """The validated 1:1 join of dealt sides by sort-merge: every supplier row has one hub row, no key comes twice
    on a side, and the sides have as many rows (``rows``: one row, ``supplier_rows``, ``hub_rows``), so no hub row
    is left over. Keys that lack a part are validated with the others and join nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy(DEALT))
    both = supplier.withColumn("_sn", n).join(hub.withColumn("_hn", n).hint("merge"), DEALT, "left")
    ok = (F.col("_sn") == 1) & (F.col("_hn") == 1) & (F.col("supplier_rows") == F.col("hub_rows"))
    whole = F.lit(True)
    for key in KEYS:
        whole = whole & F.col(DEALT)[key].isNotNull()
    return attach_scalars(both, rows).where(_checked(ok, whole)).drop("_sn", "_hn", "supplier_rows", "hub_rows")


def _results(matched: DataFrame) -> DataFrame:
    """Joined rows with difference and match flag."""
    keys = [DEALT, "supplier_code"] if DEALT in matched.columns else ["record_index", "supplier_code", *KEYS[1:]]
    return matched.select(
        *keys, "reported_quantity", "hub_quantity",
        X.difference("reported_quantity", "hub_quantity").alias("difference_quantity"),
    ).withColumn("matches", F.col("difference_quantity") == 0)


def reconcile(supplier: DataFrame, hub: DataFrame, strategy: str = "aggregate", validate: bool = True) -> DataFrame:
    """D1 + C7: the validated 1:1 join with difference and match flag.

    ``aggregate`` (default) is the single-shuffle form; ``merge`` /
    ``shuffle_hash`` / ``broadcast`` are join plans (K2), validated by the rows
    per key on either side.
    """
    if strategy == "aggregate":
        return _results(_aggregate_join(supplier, hub, validate))
    matched = _joined(supplier, hub, strategy)
    if validate:
        bad = violations(supplier, hub).agg(F.count(F.lit(1)).alias("_bad"))
        matched = attach_scalars(matched, bad).where(_checked(F.col("_bad") == 0)).drop("_bad")
    return _results(matched)


def both_plans(supplier: DataFrame, hub: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reconcile`` by ``aggregate`` and by ``merge``, validated, for ``outputs_equal``: with the key as one column,
    and from sides that are shuffled once for both plans and for their comparison."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    rows = attach_scalars(counted(supplier, "supplier_rows"), counted(hub, "hub_rows"))
    sides = _dealt(supplier, hub)
    return _results(_aggregate_join(*sides, validate=True)), _results(_merge_dealt(*sides, rows))


def sort_by_record_index(df: DataFrame) -> DataFrame:
    """G1: total order by record_index (range-partitioned global sort)."""
    return df.orderBy("record_index")


def summary(results: DataFrame) -> DataFrame:
    """match_count, mismatch_count, mismatch_rate."""
    return results.agg(
        F.count_if("matches").alias("match_count"),
        F.count_if(~F.col("matches")).alias("mismatch_count"),
        F.count(F.lit(1)).alias("input_rows"),
    ).withColumn(
        "mismatch_rate",
        F.when(F.col("input_rows") > 0, F.col("mismatch_count") / F.col("input_rows")).otherwise(F.lit(0.0)),
    )


def outputs_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """H3: two plans of one result are identical (symmetric multiset difference),
    from one aggregate over the tagged rows of both. Rows that are dealt by their
    key (``both_plans``) meet where they are."""
    cols = left.columns
    tagged = left.select(*cols, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*cols, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = (tagged if DEALT in cols else _spread(tagged, cols)).groupBy(*cols).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    zero = F.lit(0).cast("bigint")

    def total(c: F.Column, name: str) -> F.Column:
        return F.coalesce(F.sum(c), zero).alias(name)

    return counts.agg(
        total(F.col("_l"), "left_rows"), total(F.col("_r"), "right_rows"),
        total(F.greatest(F.col("_l") - F.col("_r"), zero), "left_only_rows"),
        total(F.greatest(F.col("_r") - F.col("_l"), zero), "right_only_rows"),
    ).withColumn("outputs_equal", (F.col("left_only_rows") == 0) & (F.col("right_only_rows") == 0))
