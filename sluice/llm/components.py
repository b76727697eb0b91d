"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, written


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, for every node that has a link.

    Rounds of contraction: each node points to its smallest neighbour and then to where that one points, and links between nodes become
    links between what they point to. Nodes are hashes, so a constant share of them goes with each round, and the table of links
    shrinks until it is empty. Every round is a written table: a lost executor costs one round at most.
    """
    both = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    edges = written(both.union(both.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        points = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "points")
        further = points.select(F.col("node").alias("to"), F.col("to").alias("label"))
        step = written(points.join(further, "to").select("node", "label"), "step")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        last = edges
        edges = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        edges = edges.join(step.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").filter("x <> y")
        edges = written(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(last, points, *([step] if step is not labels else []))
        if not edges.limit(1).count():
            return labels
