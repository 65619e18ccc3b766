"""Mapping version history and as-of lookups.

An upsert log of mappings (one row per upsert, ordered) becomes a versioned
history: a mapping starts at version 1 and increments only when one of its
attributes changes (null-safe comparison with the previous upsert of the same
key). The version in force at time ``t`` is found with a range join against
``[valid_from, valid_to)`` intervals: an equi-join on the mapping key plus a
range predicate, so a hot key is split by AQE's skew join. Versions and
intervals both come from the segmented scan of ``sequences``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.operators.sequences import carry_forward


def versions(upserts: DataFrame, key_cols: list[str], attr_cols: list[str], order_cols: list[str],
             method: str = "scan") -> DataFrame:
    """Version per upsert row.

    ``scan`` (default) is the skew-safe parallel segmented scan (a hot key is
    split over range partitions); ``window`` is the plain window formulation.
    """
    if method == "scan":
        from skuflow.operators.sequences import running_change_versions

        return running_change_versions(upserts, key_cols, order_cols, attr_cols)
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    changed = reduce(lambda a, b: a | b, [
        ~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in attr_cols
    ])
    first = F.row_number().over(w) == 1
    flagged = upserts.withColumn("_changed", F.when(first, F.lit(0)).otherwise(changed.cast("int")))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("version", (F.lit(1) + F.sum("_changed").over(running)).cast("int")).drop("_changed")


def intervals(history: DataFrame, key_cols: list[str], time_col: str, order_cols: list[str]) -> DataFrame:
    """Validity intervals ``[valid_from, valid_to)`` per key (``valid_to`` NULL = open),
    without holding a hot key's history in one task."""
    from skuflow.operators.sequences import next_in_key

    return next_in_key(history, key_cols, order_cols, time_col, "valid_to").withColumn("valid_from", F.col(time_col))


def as_of(facts: DataFrame, history: DataFrame, key_cols: list[str], fact_time: str,
          carry: list[str], partitions: int | None = None) -> DataFrame:
    """For each fact, the history row in force at ``fact_time`` (NULLs without one).

    ``history`` has intervals ``[valid_from, valid_to)`` that do not overlap within a key; an empty one
    (two versions of the same instant) is never in force. A NULL key or time matches nothing.
    """
    held = T.StructType([T.StructField("valid_to", history.schema["valid_to"].dataType), *(history.schema[c] for c in carry)])
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key_cols)]
    # Numbers and instants pass through JSON unchanged as strings.
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in held.names]), {"ignoreNullFields": "false"})
    versions = history.where("valid_to IS NULL OR valid_to > valid_from").select(
        *keys, F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), text.alias("_version"),
        F.lit(None).cast(facts.schema).alias("_fact"))
    asked = facts.select(*keys, F.col(fact_time).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_version"),
                         F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact"))
    places = [f"_k{i}" for i in range(len(key_cols))]
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*places, "_t"]])
    found = carry_forward(versions.unionByName(asked.where(usable)), places, ["_t", "_kind"], "_version", partitions)
    found = found.where("_kind = 1").unionByName(asked.where(~usable))
    strings = T.StructType([T.StructField(n, T.StringType()) for n in held.names])
    read = found.withColumn("_v", F.from_json("_version", strings))
    until = F.col("_v.valid_to").cast(held["valid_to"].dataType)
    in_force = until.isNull() | (F.col("_t") < until)
    return read.select("_fact.*", *[F.when(in_force, F.col(f"_v.{c}")).cast(held[c].dataType).alias(c) for c in carry])
