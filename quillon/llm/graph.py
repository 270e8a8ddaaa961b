"""Connected components over an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.staging import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to (node long, label long), the label being the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows
    the label's own label, so chains halve; rounds end when no label changes.
    Nodes without an edge are not returned; self-edges and repeated edges are
    harmless, nulls are left out, and no edge gives an empty table.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        merged = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("hop"), F.col("label").alias("beyond"))
        jumped = merged.join(over, merged.label == over.hop, "left").select(
            "node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "was"
        )
        jumped = stage(jumped, "labels")
        changed = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
