"""Connected components by repeated minimum labels with pointer jumping; nothing reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that is reachable over ``edges`` (a long, b long).

    Nodes without edges have no row. The rounds grow with the logarithm of a component's diameter.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        fresh = saved(step, "labels")
        changed = fresh.where("old <> component").limit(1).count()
        drop(labels)
        labels = fresh
        if not changed:
            drop(both)
            return labels.select("node", "component")
