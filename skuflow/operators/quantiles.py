"""Exact interpolated quantiles without funnelling a whole group into one task.

``percentile(x, p)`` keeps every distinct value of a group in one reducer's hash
map; on a day of a 100 TB history that is unbounded. Here the exact linear-
interpolated quantile (the NumPy / DuckDB ``quantile_cont`` definition) takes two
reads of the values:

1. ``sketch_columns``: a fixed-size Greenwald-Khanna sketch (``percentile_approx``,
   partial per task, merged) and a count. With accuracy A its elements are
   within N/A ranks, so the elements some margin below and above a probability
   bracket the wanted order statistics; of a fixed grid of margins the narrowest
   that is sure to do so for N rows is taken;
2. ``resolve``: one aggregate counts all rows at once, by value inside a bracket and
   by gap outside of all. A bracket is cut into equal parts: running counts over
   the parts (a fixed number of rows) tell in which parts the wanted ranks lie, and
   running counts over the values of those parts which values they are.

Every aggregate is partial/final, so a hot value or group is combined before it
shuffles, and no task holds a whole bracket. The second step refers to its
counts twice; at run time the exchange under them is reused, so the values are
read once for each step. A rank outside its bracket would fail the plan, not give a wrong value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions.frames import attach_scalars

DEFAULT_ACCURACY = 100_000
PARTS = 1024


def _margins(accuracy: int) -> list[float]:
    """Distances from a probability, narrow to wide; the last one reaches both ends."""
    return [3.0 / accuracy, *(m for m in (1e-3, 1e-2, 1e-1) if m > 3.0 / accuracy), 1.0]


def sketch_columns(x: Column, probs: list[float], accuracy: int = DEFAULT_ACCURACY) -> list[Column]:
    """Aggregates ``_n`` and ``_a`` over ``x``, from which ``resolve`` takes its brackets."""
    at = [min(1.0, max(0.0, p + sign * m)) for p in sorted(probs) for m in _margins(accuracy) for sign in (-1, 1)]
    return [F.count(x).alias("_n"), F.percentile_approx(x, F.array(*[F.lit(q) for q in at]), accuracy).alias("_a")]


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    names: list[str],
    group_cols: list[str] | tuple[str, ...] = (),
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """One row per non-empty group: ``group_cols + names``.

    Without ``group_cols`` exactly one row is returned (NULLs for empty input).
    """
    g = list(group_cols)
    base = df.select(*g, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    stats = base.groupBy(*g).agg(*sketch_columns(F.col("_x"), probs, accuracy))
    return resolve(base, stats, probs, names, g, accuracy)


def resolve(base: DataFrame, stats: DataFrame, probs: list[float], names: list[str], group_cols: list[str],
            accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Quantiles of ``base`` (groups and ``_x``, not NULL) from ``stats`` (groups, ``_n``, ``_a``)."""
    g, margins = group_cols, _margins(accuracy)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    probs, names = [probs[i] for i in order], [names[i] for i in order]

    def edge(i: int, side: int) -> Column:
        # Two ranks are wanted, and the sketch may be off by n / accuracy.
        sure = [(F.lit(m) - F.lit(1.0 / accuracy)) * F.col("_n") >= 3 for m in margins[:-1]]
        place = [2 * (i * len(margins) + j) + side for j in range(len(margins))]
        return reduce(lambda rest, j: F.when(sure[j], F.col("_a")[place[j]]).otherwise(rest),
                      reversed(range(len(sure))), F.col("_a")[place[-1]])

    edges = stats.where("_n > 0").select(*g, "_n", *[edge(i, 0).alias(f"_lo{i}") for i in range(len(probs))],
                                         *[edge(i, 1).alias(f"_hi{i}") for i in range(len(probs))])
    # One row per group: broadcast if there is one group, else an equi-join that
    # AQE turns into a broadcast when it is small.
    rows = base.join(edges, g) if g else attach_scalars(base, edges)
    x = F.col("_x")
    inside = [(x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")) for i in range(len(probs))]
    within = reduce(lambda a, b: a | b, inside)

    def part(i: int) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * PARTS)).otherwise(0).cast("int") + (i * (PARTS + 2) + 1)

    # Ascending with the value: gap, parts of the first bracket, next gap, ...
    gap = reduce(lambda a, b: a + b, [(x > F.col(f"_hi{i}")).cast("int") for i in range(len(probs))]) * (PARTS + 2)
    # Never NULL, so that the join below adds no filter under the counts and both uses of them share an exchange.
    place = F.coalesce(reduce(lambda rest, i: F.when(inside[i], part(i)).otherwise(rest), reversed(range(len(probs))), gap), F.lit(0))
    counts = rows.groupBy(*g, place.alias("_place"), F.when(within, x).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))

    # One row per part or gap: a fixed number per group.
    running = Window.partitionBy(*g).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*g, "_place").agg(F.sum("_c").alias("_rows"), F.first("_n").alias("_of")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"),
                               (F.ceil if up else F.floor)(F.lit(p) * (F.col("_of") - 1)).alias("k"))
                      for i, p in enumerate(probs) for up in (False, True)])
    first, end = F.col("_before"), F.col("_before") + F.col("_rows")
    hit = parts.withColumn("_hits", F.filter(ranks, lambda r: (r["k"] >= first) & (r["k"] < end))).where(
        F.size("_hits") > 0).select(*g, "_place", "_before", "_hits")
    values = Window.partitionBy(*g, "_place").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.join(hit, [*g, "_place"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(values))
    low, high = F.col("_cum") - F.col("_c"), F.col("_cum")
    found = found.select(*g, "_n", "_v", F.explode(F.filter("_hits", lambda r: (r["k"] >= low) & (r["k"] < high))).alias("_r"))
    value = F.coalesce("_v", F.raise_error(F.lit("A quantile lies outside the bracket of its sketch.")).cast("double"))

    def picked(i: int, up: bool) -> Column:
        return F.max(F.when((F.col("_r.i") == i) & (F.col("_r.up") == up), value))

    def quantile(i: int, p: float) -> Column:
        t = F.lit(p) * (F.max("_n") - 1)
        return picked(i, False) + (t - F.floor(t)) * (picked(i, True) - picked(i, False))

    wide = found.groupBy(*g).agg(*[quantile(i, p).alias(names[i]) for i, p in enumerate(probs)])
    if g:
        return wide  # groups without a value are absent; callers left-join
    one = base.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    return one.unionByName(wide).agg(*[F.max(n).alias(n) for n in names])


def approx_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    names: list[str],
    group_cols: list[str] | tuple[str, ...] = (),
    accuracy: int = 1000,
) -> DataFrame:
    """Greenwald-Khanna quantiles (an actual element, rank error N/accuracy)."""
    g = list(group_cols)
    agg = df.groupBy(*g).agg(
        F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs]), accuracy).alias("_a")
    )
    return agg.select(*g, *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])
