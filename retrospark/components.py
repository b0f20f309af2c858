"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.storage import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable). edges: a, b (any direction; loops are allowed).

    Labels go to neighbours and keep the smallest; then each label is replaced by its own label (pointer jumping), so
    that long paths shrink quickly. Messages are reduced before they are shuffled; a node with very many edges has its
    edges' side of the join split by AQE, as its label is one row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    rounds_labels = labels
    for _ in range(max_rounds):
        sent = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(sent, labels.node == sent.a).select("node", F.least("label", "m").alias("next"), F.col("label").alias("before"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("j"), F.col("next").alias("over"))
        after = lower.join(jump, lower.next == jump.j, "left").select("node", F.coalesce(F.least("next", "over"), "next").alias("label"), (F.coalesce(F.least("next", "over"), "next") != F.col("before")).alias("moved"))
        after = materialize(after, "labels")
        discard(lower, rounds_labels)
        rounds_labels, labels = after, after.select("node", "label")
        if not after.agg(F.bool_or("moved")).first()[0]:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    discard(both)
    return labels.withColumnRenamed("label", "component")
