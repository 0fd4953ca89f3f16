"""Connected components of a large graph by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import cut, gathered


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    At first every node keeps the edge to its smallest neighbour below it and ties its other lower neighbours to that one
    (the same components with about one edge per node). Every round then takes the smallest label among the neighbours and then the label of the label, so long chains halve.
    Minima combine map-side, and a node with very many edges is one row on the side that Spark's skew splitting copies.
    All steps run in as many tasks as the edges need, not in one for every shuffle partition.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    count = pairs.count()

    def few_tasks(df: DataFrame) -> DataFrame:
        return gathered(df, 2 * count)  # at most two rows an edge, both ways or its two nodes

    pairs = few_tasks(pairs)
    lowest = cut(few_tasks(pairs.groupBy("a").agg(F.min("b").alias("low"))))
    others = few_tasks(pairs.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
    few = cut(few_tasks(lowest.select("a", F.col("low").alias("b")).unionByName(others).distinct()))
    both = cut(few_tasks(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    labels = cut(few_tasks(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label"))))
    while True:
        met = few_tasks(both.join(labels, both["b"] == labels["node"]))
        near = met.groupBy("a").agg(F.min("label").alias("near"))
        pulled = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        pulled = cut(few_tasks(pulled))
        up = pulled.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        jumped = cut(few_tasks(pulled.join(up, F.col("label") == F.col("up"), "left").select(
            "node", "old", F.least(F.col("label"), F.coalesce("upper", "label")).alias("label"))))
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
