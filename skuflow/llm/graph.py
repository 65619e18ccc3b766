"""Connected components of an edge table, as rounds of joins and minima.

Every vertex carries a label, at first itself. A round gives each vertex the
least label among its own, its neighbours' and the one that its label vertex
was offered, then follows the label once more (pointer jumping), so a chain of
n vertices takes about log n rounds. Each round is written to the shared folder.
All aggregates are minima, so a vertex with very many edges is combined before
the shuffle; labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, label)`` for every vertex of an edge; label: the least vertex of its component."""
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("n")).where("v <> n")
    both = staged(pairs.unionByName(pairs.select(F.col("n").alias("v"), F.col("v").alias("n"))).distinct(), "edges")
    labels = staged(both.groupBy("v").agg(F.min("n").alias("m"))
                    .select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("n"), F.col("label").alias("offer")), "n")
                .groupBy("v").agg(F.min("offer").alias("offer")))
        offered = labels.join(near, "v").select("v", "label", F.least("label", "offer").alias("best"))
        hooks = offered.where("best < label").groupBy("label").agg(F.min("best").alias("best"))
        merged = (offered.select("v", "best").unionByName(hooks.select(F.col("label").alias("v"), "best"))
                  .groupBy("v").agg(F.min("best").alias("label")))
        merged = staged(merged, "labels")
        jump = merged.select(F.col("v").alias("label"), F.col("label").alias("far"))
        after = staged(merged.join(jump, "label").select("v", F.least("label", "far").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "v").where("label <> was")
        done = changed.isEmpty()
        labels = after
        if done:
            return labels.select(F.col("v").alias("vertex"), "label")
