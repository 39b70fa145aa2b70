"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.storage import discard, durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): the component's smallest node.

    Each round a node takes the smallest label among its own, its neighbours' and its label's label;
    labels are written between rounds, and those of the round before removed. Loops and repeated
    edges do no harm; no edges give no rows.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = durable(both.distinct(), "edges")
    labels = durable(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = durable(step.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        discard(labels)
        labels = moved
        if not moved.filter("old <> label").take(1):
            discard(both)
            return moved.select("node", "label")
