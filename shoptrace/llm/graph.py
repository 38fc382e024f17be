"""Connected components of a large undirected graph by label passing with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptrace.sources.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; the component is its smallest node.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so long chains
    shorten geometrically. Every round is written to the shared folder; only a changed-rows count reaches the driver.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b")
        lowest = near.groupBy("a").agg(F.min("theirs").alias("theirs"))
        own = labels.join(lowest, "a").select("a", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        after = materialise(
            own.join(jump, "label", "left").select("a", "before", F.coalesce("further", "label").alias("label")), "labels"
        )
        labels = after.select("a", "label")
        if after.filter("label <> before").limit(1).count() == 0:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
