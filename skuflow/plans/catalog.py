"""Registry of named queries: a Spark plan and, where expressible, the DuckDB
oracle SQL that computes the same result independently.

Query modules register themselves with :func:`register`; ``load()`` imports
them all. Each callable takes ``(spark, sf_dir)`` and returns a DataFrame
whose column names match the oracle's.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skuflow.plans.oracle_views import VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

MODULES = [
    "skuflow.plans.q_risk",
    "skuflow.plans.q_pipeline",
    "skuflow.plans.q_recon",
    "skuflow.plans.q_imports",
    "skuflow.plans.q_lifecycle",
    "skuflow.plans.q_reports",
    "skuflow.plans.q_audits",
    "skuflow.plans.q_scalars",
    "skuflow.plans.q_telemetry",
    "skuflow.plans.q_sources",
]


def register(key: str, sql: str | None = None, views: list[str] | tuple[str, ...] = ()):
    """Register a Spark query under ``key`` with an optional oracle.

    ``views`` names oracle views prepended as CTEs to ``sql``.
    """

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        prepared.__name__ = fn.__name__
        prepared.__doc__ = fn.__doc__
        QUERIES[key] = prepared
        if sql is not None:
            ORACLE[key] = with_views(sql, views)
        return fn

    return deco


def prepare(spark: SparkSession) -> None:
    """Session settings the plans rely on (UTC instants, last-wins map keys)."""
    from skuflow.session import BASE_CONF, RUNTIME_KEYS

    for k in RUNTIME_KEYS:
        if spark.conf.get(k, None) != BASE_CONF[k]:
            spark.conf.set(k, BASE_CONF[k])


def with_views(sql: str, views) -> str:
    """Prepend the named views (and the views they depend on) as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        deps, _ = VIEWS[name]
        for d in deps:
            visit(d)
        ordered.append(name)

    for v in views:
        visit(v)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1].strip()}\n)" for n in ordered)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


_loaded = False


def load() -> None:
    global _loaded
    if _loaded:
        return
    for m in MODULES:
        importlib.import_module(m)
    _loaded = True


def queries() -> dict[str, QueryFn]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLE)
