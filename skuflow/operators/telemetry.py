"""Operational metrics from the HTTP request log.

The reference computes these in PromQL over scraped counters, histograms and
a gauge. Re-aimed onto the request log itself (one row per completed request,
``completed_at`` and ``duration_s``):

* J6 request rate: sliding 5-minute windows every minute, count / 300 s;
* J7 p95 latency: cumulative bucket counts per 5-minute window and route,
  quantile by linear interpolation inside the bucket (``histogram_quantile``);
* J8 requests in progress: the gauge as scraped every 5 s, a running sum of
  starts and ends taken per day on top of the days before;
* E13 duration stats: min / median / p95 / max with exact interpolation.

Batch and streaming share these functions; streaming adds a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuflow.operators.quantiles import exact_quantiles

# The metrics library's default histogram bucket bounds (seconds).
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
SCRAPE_INTERVAL_US = 5_000_000
WINDOW = "5 minutes"
SLIDE = "1 minute"


def request_rate(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """Requests per second over sliding 5-minute windows, by status.

    In batch, requests are counted per minute first and each count goes to the
    five windows over it; a stream assigns windows to its rows.
    """
    if log.isStreaming:
        w = log.groupBy(F.window(time_col, WINDOW, SLIDE).alias("w"), "status").agg(
            F.count(F.lit(1)).alias("requests"))
    else:
        minutes = log.groupBy(F.date_trunc("minute", time_col).alias("_m"), "status").agg(F.count(F.lit(1)).alias("n"))
        w = minutes.groupBy(F.window("_m", WINDOW, SLIDE).alias("w"), "status").agg(F.sum("n").alias("requests"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status",
                    "requests", (F.col("requests") / 300.0).alias("rate_per_second"))


def histogram_quantile(log: DataFrame, q: float = 0.95, buckets: list[float] = DEFAULT_BUCKETS,
                       time_col: str = "completed_at", group: str = "route") -> DataFrame:
    """``histogram_quantile(q, ...)`` per 5-minute window and route."""
    d = F.col("duration_s")
    if log.isStreaming:
        counts = log.groupBy(F.window(time_col, WINDOW, SLIDE).alias("w"), group).agg(
            F.array(*[F.count_if(d <= F.lit(b)) for b in buckets]).alias("cum"),
            F.count(F.lit(1)).alias("total"),
        )
    else:
        minutes = log.groupBy(F.date_trunc("minute", time_col).alias("_m"), group).agg(
            *[F.count_if(d <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(buckets)], F.count(F.lit(1)).alias("_n"))
        counts = minutes.groupBy(F.window("_m", WINDOW, SLIDE).alias("w"), group).agg(
            F.array(*[F.sum(f"_b{i}") for i in range(len(buckets))]).alias("cum"), F.sum("_n").alias("total"))
    bounds = F.array(*[F.lit(b) for b in buckets])
    rank = F.lit(q) * F.col("total")
    # 1-based index of the first finite bucket whose cumulative count reaches rank.
    idx = F.array_position(F.transform("cum", lambda c: c >= rank), True)
    upper = F.element_at(bounds, idx.cast("int"))
    lower = F.when(idx > 1, F.element_at(bounds, (idx - 1).cast("int"))).otherwise(F.lit(0.0))
    below = F.when(idx > 1, F.element_at("cum", (idx - 1).cast("int"))).otherwise(F.lit(0))
    inside = F.element_at("cum", idx.cast("int")) - below
    value = F.when(idx == 0, F.lit(buckets[-1])).otherwise(
        lower + (upper - lower) * (rank - below) / inside)
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group,
                         "total", value.alias("p95_seconds"))


def gauge_changes(log: DataFrame, time_col: str = "completed_at", longest_us: int | None = None) -> DataFrame:
    """``(t, n)``: +1 at a request's first sample instant and -1 after its last, in microseconds. With
    ``longest_us``, a request that took longer counts for that long."""
    step, end_us, took = SCRAPE_INTERVAL_US, F.unix_micros(F.col(time_col)), F.col("duration_us")
    if longest_us is not None:
        took = F.least(took, F.lit(longest_us))
    first = F.ceil((end_us - took) / step).cast("bigint") * step
    after = F.floor((end_us - 1) / step).cast("bigint") * step + step
    return log.select(F.explode(F.array(
        F.struct(first.alias("t"), F.lit(1).alias("n")), F.struct(after.alias("t"), F.lit(-1).alias("n")))).alias("c")).select("c.*")


def requests_in_progress(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """In-flight requests at each 5 s sample instant t (start <= t < end),
    every instant from the first start to the last end, idle ones with 0.

    A request is two changes, +1 at its first instant and -1 after its last,
    whatever its duration. Changes are summed per instant, the running sum is
    taken within days, and each day starts from the sum of the days before it
    (one row per day).
    """
    step, day = SCRAPE_INTERVAL_US, 86_400_000_000
    per_instant = gauge_changes(log, time_col).groupBy("t").agg(F.sum("n").alias("n"))
    span = per_instant.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi")
    days = span.select("lo", "hi", F.explode(F.sequence(F.expr(f"lo div {day}"), F.expr(f"(hi - {step}) div {day}"))).alias("d"))
    instants = days.select("d", F.explode(F.sequence(
        F.greatest("lo", F.col("d") * day + F.pmod(-F.col("d") * day, F.lit(step))),
        F.least(F.col("hi") - step, (F.col("d") + 1) * day - 1), F.lit(step))).alias("t"))
    marked = instants.join(per_instant, "t", "left").fillna(0, subset=["n"])
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    opening = marked.groupBy("d").agg(F.sum("n").alias("n")).select(
        "d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("open"))
    running = F.sum("n").over(Window.partitionBy("d").orderBy("t"))
    return marked.withColumn("run", running).join(opening, "d").select(
        F.timestamp_micros("t").alias("sampled_at"), (F.col("run") + F.col("open")).cast("bigint").alias("in_progress"))


def duration_stats(log: DataFrame, group: str = "route") -> DataFrame:
    """Min / median / p95 (linear interpolation) / max per group."""
    q = exact_quantiles(log, "duration_s", [0.5, 0.95], ["median_seconds", "p95_seconds"], [group])
    mm = log.groupBy(group).agg(F.min("duration_s").alias("min_seconds"), F.max("duration_s").alias("max_seconds"),
                                F.count(F.lit(1)).alias("samples"))
    return mm.join(q, group)
