"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node that it is connected with.

    Alternates hooking onto the least neighbour's label with pointer jumping; each round is written to the shared
    folder, so lineage stays short. Groups are only ever reduced with min, never gathered."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), what)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), what)
    last = labels
    while True:
        # labels of the neighbours' labels, then one jump
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # what a member has learnt, its label's node learns too
        told = hooked.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("told"))
        hooked = hooked.join(told, "node", "left").select("node", "old", F.least("label", F.coalesce("told", "label")).alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), what)
        changed = new.where("old <> label").limit(1).count()
        remove(last)
        last, labels = new, new.select("node", "label")
        if not changed:
            remove(both)
            return labels
