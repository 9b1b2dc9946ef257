"""Connected components of an edge table, by least labels with pointer jumping.

Every round takes the least label among a node's neighbours, then the label of
that label; rounds are written to the shared folder, and their number grows with
the logarithm of a component's width. Nothing is collected but counts. Nodes are
numbers, so that all aggregates are hash aggregates; labels are broadcast while
their bytes allow it and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, materialize


def contract(edges: DataFrame, most_broadcast: int) -> DataFrame:
    """Fewer edges of the same components: a node keeps its least neighbour v, which takes over the others."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("least")), "least")
    over = edges.join(broadcast_if(least, most_broadcast), "u").filter("v <> least").select(F.col("least").alias("u"), "v").distinct()
    return least.select("u", F.col("least").alias("v")).union(over)


def components(edges: DataFrame, most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (u, v)."""
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    n = labels.count()
    small = 24 * n <= most_broadcast
    side = F.broadcast if small else (lambda df: df)
    few = (lambda df: df.coalesce(1 + n // 50_000)) if small else (lambda df: df)
    while True:
        near = both.join(side(labels.select(F.col("node").alias("v"), "label")), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        better = near.join(side(labels.select("node", "label")), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        better = materialize(few(better), "labels")
        up = side(better.select(F.col("node").alias("label"), F.col("label").alias("up")))
        jumped = better.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label"))
        labels = materialize(few(jumped), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
