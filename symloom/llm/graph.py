"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of a link ``(a, b)``.

    The component is the smallest id reachable.  Each round takes the smallest
    label among a node and its neighbours, then the label of that label: about log
    n rounds for a chain of n nodes in order of id, but as many as links lie
    between where the smallest id meets a node whose label was the least so far
    and that label's own node.  Every round is written to the
    shared folder; the driver sees only the number of labels that changed.
    """
    both = materialise(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        moved = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = moved.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = materialise(moved.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        labels = new.select("id", "component")
        if not new.filter("old <> component").limit(1).count():
            return labels
