"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours, then follows labels to their own
    labels, so that chains halve. Labels live in tables in the shared folder. No edges: no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = materialize(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid")), "step")
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = materialize(step.join(up, "mid").select("node", "old", F.least("mid", "top").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        discard(step, labels)
        labels = new.select("node", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            discard(both)
            return labels


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after edges between labels: every node of `labels`, and every label of an edge."""
    new = components(edges)
    moved = labels.join(new.select(F.col("node").alias("__node"), F.col("label").alias("__label")), F.col("label") == F.col("__node"), "left").select("node", F.coalesce("__label", "label").alias("label"))
    out = materialize(moved.unionByName(new.join(labels, "node", "left_anti").select("node", "label")), "labels")
    discard(new, labels)
    return out
