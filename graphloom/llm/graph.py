"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then that label's own label, until none changes;
    labels only fall, so it ends, and rounds grow with the logarithm of the diameter in practice. Sums run map side first. A
    node with very many neighbours, or a label of very many nodes, is many rows of two numbers in one side of a join: sort-merge
    joins, whose skewed partitions adaptive execution splits. Every round's labels are written to the shared folder, which
    ends their lineage.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.hint("merge").join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("then"))
        moved = hooked.hint("merge").join(jump, F.col("label") == F.col("via"), "left").select("node", "was", F.least("label", F.coalesce("then", "label")).alias("label"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
