"""Connected components of links between 64-bit vertices, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relops.staging import stage


def connected(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex that has a link: columns ``vertex`` and ``component``.

    ``links`` has columns ``a`` and ``b``. In each round a vertex takes the smallest label of its neighbours and then
    that label's own label, so stars need two rounds and chains a number that grows with the logarithm of their
    length. Every round is written to the shared folder; only a count reaches the driver.
    """

    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = stage(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["vertex"] == near["a"]).select("vertex", F.least("component", "near").alias("component"))
        jump = lower.select(F.col("vertex").alias("target"), F.col("component").alias("beyond"))
        after = lower.join(jump, lower["component"] == jump["target"]).select(
            "vertex", F.least("component", "beyond").alias("component")
        )
        after = stage(after, "labels")
        before = labels.withColumnRenamed("component", "was")
        moved = after.join(before, "vertex").filter(F.col("component") != F.col("was"))
        labels = after
        if moved.isEmpty():
            return labels
