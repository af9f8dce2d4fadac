"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.sources.scratch import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of ``edges`` with the smallest node it can reach.

    Each round takes the smallest label among a node and its neighbours, then the label of that label (which halves the
    distance to the smallest node); the rounds end when no label changes. Rounds are written tables, so lineage stays short
    and lost executors only repeat their tasks. All joins are plain equi-joins that adaptive execution may split.
    """
    both = edges.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e"))
    both = materialise(both.select("e.x", "e.y").distinct(), "edges")
    rows = both.count()  # bounds the number of nodes
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component"))
    labels = materialise(labels, "labels", rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("node", "old", F.coalesce(F.least("component", "further"), "component").alias("component"))
        step = materialise(step, "labels", rows)
        labels = step.drop("old")
        if step.where("component <> old").isEmpty():
            return labels
