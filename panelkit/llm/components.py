"""Connected components of an edge table by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest
    node reachable.

    Each round gives every node the smallest label around it, then follows
    the label's own label, which halves long chains; rounds end when no label
    changes, after a number that grows with the logarithm of the diameter.
    Labels are checkpointed every round.  Joins are on node ids (AQE splits a
    hub's rows); minima are combined map-side.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("near")) \
            .agg(F.min("comp").alias("near_comp"))
        step = labels.join(around, F.col("node") == F.col("near")).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near_comp").alias("comp"))
        hop = labels.select(F.col("node").alias("h_node"), F.col("comp").alias("h_comp"))
        new = cut_lineage(step.join(hop, F.col("comp") == F.col("h_node"), "left").select(
            "node", "old", F.least("comp", F.coalesce("h_comp", "comp")).alias("comp")))
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
