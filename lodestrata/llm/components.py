"""Connected components of an undirected graph, by joins and pre-aggregated minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b).

    Each round takes the smallest label of a node's neighbours and then the label of that label, so paths shrink by
    more than half. Nothing is gathered by node: minima are pre-aggregated, and the joins may be split by the engine.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        nearest = seen.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        beyond = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = nearest.join(beyond, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        fresh = durable(jumped)
        moved = fresh.join(labels.select("node", F.col("component").alias("was")), "node").where("component != was")
        labels, done = fresh, moved.isEmpty()
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
