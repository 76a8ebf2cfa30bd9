"""Connected components of an edge table by min-label propagation with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node of its component.

    Each round a node takes the smallest label among itself and its neighbours, and then its label's label, so
    that a path of n nodes needs about log n rounds.  Labels are written to the shared folder after each round.
    Edges with a null end count for nothing; an empty table gives an empty result.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        step = step.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("comp"), (F.coalesce("lower", "low") != F.col("comp")).alias("moved"))
        step = stored(step, "labels")
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels
