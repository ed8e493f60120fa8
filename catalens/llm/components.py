"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import staged


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link.

    Each round a node takes the smallest label among its neighbours and its
    label's label; every round is written, so a lost executor costs one round.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    both = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        found = staged(nearer.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        changed = found.where("component <> old").limit(1).count()
        labels = found.select("node", "component")
        if not changed:
            return labels
