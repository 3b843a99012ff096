"""Connected components of an edge table, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_spark.session import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is its smallest node.

    Every node points to the smallest node it knows. In each round the pointers meet over all edges, and the pointers'
    own pointers are followed, so the number of rounds is about the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component"))
                     .withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        target = labels.select(F.col("node").alias("b"), F.col("component").alias("there"))
        seen = both.join(target, "b").groupBy(F.col("a").alias("node")).agg(F.min("there").alias("seen"))
        # a pointer's target learns what its own followers have found, too
        met = labels.join(seen, "node").select("node", "component", F.least("component", "seen").alias("found"))
        told = met.groupBy(F.col("component").alias("node")).agg(F.min("found").alias("told"))
        new = met.join(told, "node", "left").select(
            "node", "component", F.least("found", F.coalesce("told", "found")).alias("next"))
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = new.join(jump, "next").select("node", F.col("component").alias("old"), F.col("further").alias("component"))
        new = written(new, f"{name}-round")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
