"""Mixing sources to target weights.

Sizes are added up per source; the targets come from the weights by
"reshare the excess until none is above its cap"; the ratio of target to size
is the source's repetition rate; each document goes out ``floor(rate)`` times
and once more if a draw seeded by its id is below the fraction. The draw is the
first 52 bits of the md5 of seed and id, so reruns and other engines agree.

Shuffles carry ``(id, size, source)`` only. Sizes per source are partial sums,
so a source with a third of the rows adds one row per task; the join back to
the documents is by source, which adaptive execution turns into a broadcast if
the source table's *measured* size allows it and otherwise splits where skewed.
Targets are found by rounds over the source table (each round caps all sources
that are above), never by a window over all sources.

Defined cases: null or blank texts have size 0 and are still emitted by the
draw; a null source is a source of its own, ordered last; rows with equal ids
draw alike, null ids draw as one id; sources of size 0 have target 0 and rate
0; an empty table gives an empty table. Input columns other than the three are
kept by ``mix`` and dropped by ``plan_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skuflow.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), the same for the same seed and id everywhere."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` for a table of ``(source, size)`` rows."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    ranked = spark.createDataFrame(
        ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])),
        StructType([StructField("source", StringType()), StructField("source_size", LongType()),
                    StructField("rank", LongType())]))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(ranked.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * cap
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # A round caps every source whose share of what is left exceeds its cap. The capped
    # ones are those with cap / weight below the level, which only rises.
    rest, open_weight, level = share * total, None, None
    while True:
        is_open = F.lit(True) if level is None else limit * F.lit(level[1]) >= F.col("weight") * F.lit(level[0])
        row = table.agg(F.sum(F.when(is_open, F.col("weight"))).alias("w"),
                        F.sum(F.when(~is_open, limit)).alias("capped")).first()
        rest, weight_left = share * total - float(row["capped"] or 0), row["w"]
        if not weight_left or weight_left == open_weight:
            break
        open_weight, level = weight_left, (float(rest), float(weight_left))
    level = level or (0.0, 1.0)
    fair = F.col("weight") * F.lit(level[0]) / F.lit(level[1])
    return table.select("source", "source_size", F.least(fair, limit.cast("double")).alias("target"))


def plan_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``(id, size, source, source_size, target, copies)`` for each row of ``df``."""
    sizes = staged(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                             word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    return (sizes.join(targets, F.col("source").eqNullSafe(F.col("s")))
            .select("id", "size", "source", "source_size", "target", copies.alias("copies")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with its columns unchanged."""
    sizes = df.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, weights, share, cap)
    rates = targets.select("source", F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    # The row itself is one value, so that its columns may have any names.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), draw(F.col(id_col), seed).alias("draw"),
                     F.col(source_col).cast("string").alias("of"))
    rate = F.col("rate")
    copies = (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")).cast("int")
    joined = rows.join(rates, F.col("of").eqNullSafe(F.col("source")))
    return joined.select("whole", F.explode(F.array_repeat(F.lit(1), copies))).select("whole.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s
), o AS (
  SELECT *, 2 * source_size AS cap,
         sum(2 * source_size) OVER w AS caps, sum(weight) OVER w AS weights,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM r WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * (all_weight - coalesce(weights, 0)) < weight * (1.5 * total - coalesce(caps, 0)) AS capped FROM o
), l AS (
  SELECT 1.5 * any_value(total) - coalesce(sum(cap) FILTER (WHERE capped), 0)::DOUBLE AS rest,
         coalesce(sum(weight) FILTER (WHERE NOT capped), 0)::DOUBLE AS left_weight FROM c
), t AS (
  SELECT c.source, source_size, CASE WHEN capped OR left_weight = 0 THEN cap::DOUBLE
                                     ELSE least(weight * rest / left_weight, cap::DOUBLE) END AS target
  FROM c, l
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
