"""Connected components over an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` (any orderable type, undirected) to ``(node, label)``: the smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then the label of that label (pointer
    jumping), so the rounds grow with the logarithm of the longest path. Every round ends in the shared folder.
    An empty edge table gives an empty result; self loops and repeated edges change nothing.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("label"), F.lit(True).alias("moved")),
        "labels",
    )
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        parent = labels.select(F.col("node").alias("to"), F.col("label").alias("up"))
        before, labels = labels, materialise(
            lower.join(parent, "to").select("node", F.least("to", "up").alias("label"), (F.least("to", "up") != F.col("was")).alias("moved")),
            "labels",
        )
        discard(before)
        if labels.where("moved").limit(1).count() == 0:
            discard(both)
            out = labels.select("node", "label")
            out.quarry_path = labels.quarry_path
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
