"""Connected components by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reached) for every node of the edges (longs, undirected).

    Each round takes the least label among a node and its neighbours, then the label of that label;
    rounds end when no label changes. State is written to the shared folder each round. Null ends
    and loops are left out; no edges: no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    both = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges", narrow=True)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels", narrow=True)
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_far"))
        after = materialise(
            lower.join(jump, "_low", "left").select("node", F.least("_low", "_far").alias("label"), "_old"), "labels", narrow=True
        )
        changed = after.where("label != _old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels.withColumnRenamed("label", "component")
