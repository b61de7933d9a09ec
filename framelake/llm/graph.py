"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's least node.

    Each round takes the least label among neighbours, then the label of that label, and
    writes the labels to the shared folder; rounds grow with the logarithm of the longest
    path, not with the number of edges.  Labels never reach the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("to"))
        lower = materialize(lower, "lower")
        jump = lower.select(F.col("node").alias("at"), F.col("to").alias("next"))
        moved = lower.join(jump, F.col("to") == F.col("at"), "left").select("node", "was", F.least("to", "next").alias("root"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels
