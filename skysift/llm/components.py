"""Connected components of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.session import TableStore


def components(links: DataFrame, store: TableStore, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of
    that label, so chains shorten by half or more. Every round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store.write(both, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = store.write(labels, f"{name}-0")
    for turn in range(1, 200):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        near = store.write(seen.join(labels, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_label")), f"{name}-near{turn}")
        above = near.select(F.col("node").alias("_label"), F.col("_label").alias("component"))
        new = store.write(near.join(above, "_label").select("node", "component", (F.col("component") < F.col("_old")).alias("_moved")), f"{name}-{turn}")
        labels = new.select("node", "component")
        if new.filter("_moved").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")
