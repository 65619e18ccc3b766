"""Reporting reads over the hub tables (D7-D12, D15, D16, E9-E14, F6-F9, G2-G9,
C20-C24, H2): list/filter/order/page, top-k, lineage, rollups, backlog audits.

Top-k reads compile to ``TakeOrderedAndProject`` (per-partition top-k, then a
merge of k rows per partition), pages to a sorted offset/limit; per-parent
child rollups are aggregates joined to the parent, not per-row lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow import schemas as S
from skuflow.functions import scalars as X
from skuflow.operators.sequences import ranged
from skuflow.session import materialize

# Rows that one task may hold for a page; beyond, the page is looked up by range.
SHALLOW_ROWS = 10_000


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first rows by ``order`` (a report size, not a data cap)."""
    return df.orderBy(*order).limit(k)


def paginate(df: DataFrame, order: list[Column], offset: int, limit: int, shallow: int = SHALLOW_ROWS,
             partitions: int | None = None) -> DataFrame:
    """Ordered page; limits are validated like the API (1..1000).

    ``order`` tells all rows apart. The first pages are a top-k of offset + limit rows. For a deep page
    that would bring all rows before it into one task; there rows are range-partitioned by ``order``, the
    counts of the partitions (one row each) say in which ones the page lies, and only those are sorted.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset >= 0")
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    layout = ranged(df, order, partitions)
    before, start, wanted = 0, 0, []
    for r in sorted(layout.groupBy("_pid").count().collect(), key=lambda r: r["_pid"]):
        if before < offset + limit and before + r["count"] > offset:
            start = start if wanted else before
            wanted.append(r["_pid"])
        before += r["count"]
    page = layout.where(F.col("_pid").isin(wanted)).drop("_pid") if wanted else layout.where("false").drop("_pid")
    return page.orderBy(*order).offset(offset - start).limit(limit)


def sequence_numbers(df: DataFrame, parent: list[str], order: list, name: str,
                     skew_safe: bool = False) -> DataFrame:
    """1-based position of each child within its parent.

    The window form suits children bounded per parent (lines per order,
    attempts per job). ``skew_safe`` numbers with the parallel segmented scan:
    with the (unique) ordering columns as the compared attributes every row is
    a change, so the running change count is the row number, and a parent with
    a third of all rows is spread over range partitions.
    """
    if skew_safe:
        from skuflow.operators.sequences import running_change_versions

        return running_change_versions(df, parent, order, order, out=name)
    w = Window.partitionBy(*parent).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """C23 + C24 on each attempt: retryable, failure code, status, retry delay."""
    retry, code = X.classify_failure("error_type")
    return attempts.withColumn("retryable", F.when(F.col("error_type").isNotNull(), retry)).withColumn(
        "failure_code", F.when(F.col("error_type").isNotNull(), code)
    ).withColumn(
        "status",
        F.when(F.col("error_type").isNull(), F.lit("succeeded"))
        .when(F.col("retryable"), F.lit("retry_scheduled")).otherwise(F.lit("failed")),
    ).withColumn(
        "retry_delay_seconds", F.when(F.col("retryable"), X.retry_delay_seconds("attempt_number")),
    )


def final_attempt_status(attempts: DataFrame) -> DataFrame:
    """attempt count and the status of the last attempt per job."""
    return attempts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("status", "attempt_number").alias("final_status"),
    )


def idempotent_submissions(jobs: DataFrame) -> DataFrame:
    """F8: within (supplier, source type, key) the first submission creates the
    job; a later one with the same content hash returns the original, a
    different hash is a conflict."""
    scope = ["supplier_id", "source_type", "idempotency_key"]
    first = jobs.groupBy(*scope).agg(
        F.min_by(F.struct(F.col("job_id").alias("original_job_id"), F.col("content_sha256").alias("_h")),
                 F.struct("created_at", "job_key")).alias("_f")
    )
    j = jobs.join(first, scope)
    outcome = (F.when(F.col("job_id") == F.col("_f.original_job_id"), F.lit("created"))
               .when(F.col("content_sha256") == F.col("_f._h"), F.lit("duplicate"))
               .otherwise(F.lit("conflict")))
    return j.select("job_id", *scope, F.col("_f.original_job_id").alias("original_job_id"),
                    outcome.alias("outcome"))


def latest_per(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """newest row per key (the ``latest`` pointer)."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_r")) \
        .select(*key, "_r.*")


def jobs_due(jobs: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """G8 (re-aimed backlog report): queued, retry due, not recently dispatched;
    oldest ``limit`` first."""
    now = F.lit(as_of).cast("timestamp")
    redispatch = F.timestamp_add("SECOND", F.lit(-S.IMPORT_REDISPATCH_SECONDS), now)
    due = jobs.where(
        (F.col("status") == "queued")
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
        & (F.col("dispatched_at").isNull() | (F.col("dispatched_at") <= redispatch))
    )
    return due.orderBy("created_at", "job_key").limit(limit)


def stale_leases(jobs: DataFrame, as_of: str) -> DataFrame:
    """G9 (re-aimed audit): processing jobs whose lease expired and the state
    recovery would move them to."""
    now = F.lit(as_of).cast("timestamp")
    stale = jobs.where((F.col("status") == "processing") & F.col("lease_expires_at").isNotNull()
                       & (F.col("lease_expires_at") < now))
    return stale.select(
        "job_id", "attempt_count", "max_attempts",
        F.when(F.col("attempt_count") < F.col("max_attempts"), F.lit("queued")).otherwise(F.lit("failed"))
        .alias("next_status"),
        F.lit("abandoned").alias("attempt_status"),
        F.lit("worker_lease_expired").alias("failure_code"),
    )


def replay_lineage(spark, jobs: DataFrame) -> DataFrame:
    """Replay chains (replay -> original -> ...) resolved to the root by
    pointer doubling; a replay is valid when its original failed and kept a
    payload.

    Each round joins the pointers with themselves, so a chain of n replays
    takes log2(n) rounds; chains that run in a circle never end and are
    reported.
    """
    own = jobs.select("job_id", "replay_of_job_id")
    far = materialize(own.where(F.col("replay_of_job_id").isNotNull()).select(
        "job_id", F.col("replay_of_job_id").alias("root_job_id"), F.lit(1).cast("bigint").alias("hops")))
    links = far.count()
    for _ in range(max(links, 1).bit_length() + 1):
        step = far.select(F.col("job_id").alias("root_job_id"), F.col("root_job_id").alias("_next"),
                          F.col("hops").alias("_more"))
        joined = materialize(far.join(step, "root_job_id", "left"))
        ended = joined.where(F.col("_next").isNotNull()).isEmpty()
        far = joined.select("job_id", F.coalesce("_next", "root_job_id").alias("root_job_id"),
                            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        if ended:
            break
    else:
        raise ValueError("replay_of_job_id runs in a circle")
    original = jobs.select(F.col("job_id").alias("replay_of_job_id"),
                           ((F.col("status") == "failed") & F.col("payload_size").isNotNull()).alias("valid_replay"))
    return (far.join(own, "job_id").join(original, "replay_of_job_id", "left")
            .select("job_id", "replay_of_job_id", "root_job_id", F.col("hops").cast("int").alias("hops"), "valid_replay"))


def with_children(parent: DataFrame, key: str, sections: dict[str, tuple[DataFrame, str | None, list[str]]]) -> DataFrame:
    """Each parent row with one row per child: ``(section, position, item)``.

    ``sections``: name -> (child rows, ordering column, columns shown). Children
    stay rows rather than arrays, so a parent may have any number of them.
    """
    parts = []
    for name, (child, order, shown) in sections.items():
        item = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown])
        position = (F.col(order) if order else F.lit(None)).cast("bigint")
        parts.append(child.select(key, F.lit(name).alias("section"), position.alias("position"), item.alias("item")))
    children = parts[0]
    for p in parts[1:]:
        children = children.unionByName(p)
    return parent.join(children, key, "left")


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per entity with its row count (one pass per table)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("entity"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest_object_counts(manifests: DataFrame) -> DataFrame:
    """Curated / summary object counts per manifest (non-list -> 0)."""
    return manifests.select(
        "manifest_key", F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(F.size("curated_keys"), F.lit(0)).alias("curated_object_count"),
        F.coalesce(F.size("summary_keys"), F.lit(0)).alias("summary_object_count"),
    ).withColumn("curated_object_count", F.greatest("curated_object_count", F.lit(0))) \
     .withColumn("summary_object_count", F.greatest("summary_object_count", F.lit(0)))


def verify_manifests(manifests: DataFrame) -> DataFrame:
    """Succeeded, and both key lists hold a Parquet object."""
    def has_parquet(c):
        return F.coalesce(F.exists(c, lambda k: k.endswith(".parquet")), F.lit(False))

    return manifests.select(
        "manifest_key", "status",
        ((F.col("status") == "succeeded") & has_parquet("curated_keys") & has_parquet("summary_keys"))
        .alias("verified"),
    )
