"""Connected components by smallest label, as joins of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every end of links(a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label
    of the label, so paths shrink by half; each is written, so that no lineage
    grows. Minima are formed before the exchange, and a node with very many
    links only repeats on the side of a join that Spark can split.
    """
    edges = written(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(spark, edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = written(spark, hooked.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels
