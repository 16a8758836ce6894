"""Connected components by label propagation with pointer jumping, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.runtime import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component), component being the smallest node reachable; only nodes that have an edge.

    Each round a node takes the smallest label among its neighbours' and its own, then the label of that label,
    until none changes.  The labels of a round are read back from the shared folder.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = durable(labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component")))
        if step.where("component < before").isEmpty():
            return step.select("node", "component")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = step.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
