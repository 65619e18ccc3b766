"""Operational metric queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions.scalars import utc_iso
from skuflow.operators import telemetry
from skuflow.plans.catalog import register
from skuflow.sources import views

_W = ("strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
      "strftime(window_start + INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS window_end")
_BUCKETS = "[" + ", ".join(repr(b) for b in telemetry.DEFAULT_BUCKETS) + "]"


def _windows(df):
    return df.withColumn("window_start", utc_iso("window_start")).withColumn("window_end", utc_iso("window_end"))


@register("request_rate_5m", f"""
SELECT {_W}, status, count(*) AS requests, round(count(*) / 300.0, 9) AS rate_per_second
FROM v_http_windows GROUP BY window_start, status
""", ["v_http_windows"])
def q_request_rate_5m(spark, sf):
    """Per-second request rate over sliding 5-minute windows, by status."""
    r = telemetry.request_rate(views.http_log(spark, sf))
    return _windows(r).withColumn("rate_per_second", F.round("rate_per_second", 9))


@register("latency_p95_by_route", f"""
WITH c AS (
  SELECT window_start, route, count(*) AS total,
         [{', '.join(f'count(*) FILTER (WHERE duration_s <= {b})' for b in telemetry.DEFAULT_BUCKETS)}] AS cum
  FROM v_http_windows GROUP BY window_start, route),
i AS (SELECT *, 0.95 * total AS rk, list_position(list_transform(cum, lambda c: c >= 0.95 * total), true) AS idx
      FROM c),
v AS (SELECT *, coalesce(idx, 0) AS ix FROM i)
SELECT {_W}, route, total,
       round(CASE WHEN ix = 0 THEN {telemetry.DEFAULT_BUCKETS[-1]}
            ELSE (CASE WHEN ix > 1 THEN {_BUCKETS}[ix - 1] ELSE 0.0 END)
                 + ({_BUCKETS}[ix] - CASE WHEN ix > 1 THEN {_BUCKETS}[ix - 1] ELSE 0.0 END)
                 * (rk - CASE WHEN ix > 1 THEN cum[ix - 1] ELSE 0 END)
                 / (cum[ix] - CASE WHEN ix > 1 THEN cum[ix - 1] ELSE 0 END) END, 9) AS p95_seconds
FROM v
""", ["v_http_windows"])
def q_latency_p95_by_route(spark, sf):
    """Histogram p95 by route over sliding 5-minute windows."""
    h = telemetry.histogram_quantile(views.http_log(spark, sf))
    return _windows(h).withColumn("p95_seconds", F.round("p95_seconds", 9))


@register("requests_in_progress", """
WITH b AS (
  SELECT CAST(ceil((end_us - duration_us) / 5000000) AS BIGINT) * 5000000 AS lo,
         CAST(floor((end_us - 1) / 5000000) AS BIGINT) * 5000000 AS hi
  FROM v_http),
s AS (SELECT unnest(range(lo, hi + 1, 5000000)) AS t FROM b),
n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
i AS (SELECT unnest(range((SELECT min(least(lo, hi + 5000000)) FROM b), (SELECT max(greatest(lo, hi + 5000000)) FROM b),
                          5000000)) AS t)
SELECT strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ') AS sampled_at, coalesce(n, 0) AS in_progress
FROM i LEFT JOIN n USING (t)
""", ["v_http"])
def q_requests_in_progress(spark, sf):
    """Requests in flight at each 5 s scrape instant."""
    g = telemetry.requests_in_progress(views.http_log(spark, sf))
    return g.withColumn("sampled_at", utc_iso("sampled_at"))


@register("duration_stats", """
SELECT route, min(duration_s) AS min_seconds, max(duration_s) AS max_seconds, count(*) AS samples,
       round(quantile_cont(duration_s, 0.5), 9) AS median_seconds, round(quantile_cont(duration_s, 0.95), 9)
         AS p95_seconds
FROM v_http GROUP BY route
""", ["v_http"])
def q_duration_stats(spark, sf):
    """Min / median / p95 / max request duration per route."""
    s = telemetry.duration_stats(views.http_log(spark, sf))
    return s.withColumn("median_seconds", F.round("median_seconds", 9)).withColumn(
        "p95_seconds", F.round("p95_seconds", 9))
