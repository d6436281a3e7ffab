"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges (a, b), label the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label. Rounds are
    written to the shared folder. A node with many edges is no hot task: minima are aggregated before the shuffle, and
    the joins are ones whose large partitions Spark splits.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "low").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        moved = scratch.keep(lower.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
