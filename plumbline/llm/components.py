"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b long); the component is its smallest node.

    Labels start at the node itself and take, in each round, the smallest label of a neighbour and then the label of that label, so
    chains halve. Each round is written to the checkpoint folder; the driver sees one count a round.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        lower = materialise(
            labels.join(near, labels["node"] == near["a"]).select(
                "node", F.col("component").alias("was"), F.least("component", "low").alias("via")
            )
        )
        jump = lower.select(F.col("node").alias("via"), F.col("via").alias("to"))
        after = materialise(lower.join(jump, "via").select("node", "was", F.least("via", "to").alias("component")))
        moved = after.where("component <> was").limit(1).count()
        release(lower, labels)
        if not moved:
            release(both)
            return materialise(after.select("node", "component"))
        labels = materialise(after.select("node", "component"))
        release(after)
