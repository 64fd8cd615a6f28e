"""Connected components of a link table, as joins that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node can reach.

    ``links`` has the columns a and b. Each round takes the smallest label among
    a node's neighbours and then the label of that label, so that paths halve;
    the labels of a round are a written table. Labels only fall, so the rounds
    end when none has changed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.settle(both.where("a != b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    labels = common.settle(labels.select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("further"))
        after = lower.join(jump, "lower").select(
            "node", F.least("lower", "further").alias("component"), (F.least("lower", "further") < F.col("component")).alias("fell")
        )
        after = common.settle(after, "labels")
        changed = not after.where("fell").isEmpty()
        labels = after.select("node", "component")
        if not changed:
            return labels
