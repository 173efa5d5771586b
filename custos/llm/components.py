"""Connected components of an edge list, as DataFrame joins to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.llm.scratch import Scratch


def connected(edges: DataFrame, s: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest
    node reachable. Each round every node takes the least label among itself and
    its neighbours (one joined row an edge, aggregated map-side), then the label
    of that label, so long chains halve. Each round ends in a written table of ``s``; the
    driver reads one number a round: whether a label changed."""
    e = s.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .where("a <> b").distinct())
    label = s.table(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = (e.join(label.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = label.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("up"))
        over = label.select(F.col("node").alias("up"), F.col("component").alias("beyond"))
        step = s.table(step.join(over, "up", "left").select(
            "node", "was", F.least("up", F.coalesce("beyond", "up")).alias("component")))
        label = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return label
