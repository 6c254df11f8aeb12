"""Connected components of a table of edges, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b); the component is its smallest node.

    A round gives each node the smallest label among its neighbours' and its own, then the label of that
    label, so labels only sink, and the rounds end when none does. Each round is written to the checkpoint folder; only
    whether anything changed reaches the driver. Without edges the result is empty.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_offer"))
        nearer = labels.join(offered, "node", "left").select("node", "component", F.least("component", "_offer").alias("_near"))
        jump = labels.select(F.col("node").alias("_near"), F.col("component").alias("_far"))
        new = checkpoint(nearer.join(jump, "_near", "left").select("node", F.least("_near", "_far").alias("component"), (F.least("_near", "_far") < F.col("component")).alias("_changed")))
        changed = new.where("_changed").limit(1).count()
        labels = new.drop("_changed")
        if not changed:
            return labels
