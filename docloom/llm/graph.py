"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node with an edge; the label is the least node that it is joined to.

    Every round each node takes the least label among its own and its neighbours' and then its label's
    label, so the number of rounds goes with the logarithm of the longest chain. Only counts of changes
    reach the driver; each round is written to the checkpoint folder.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = cut_lineage(both.where("node <> other").distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = step.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new"))
        moved = cut_lineage(moved)
        if moved.where("new <> label").limit(1).count() == 0:
            return labels
        labels = moved.select("node", F.col("new").alias("label"))
