"""Connected components of a link table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, and is written to the shared folder; it ends when
    no label changes. Minima are combined before the shuffle, so a node with
    very many links costs one row a task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = save(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("seen"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("root"))
        step = save(lower.join(jump, "now").select("node", "was", F.least("now", "root").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
