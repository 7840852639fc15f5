"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def ordered_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (a, b), a < b, of two columns."""
    return rows.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the label is the component's smallest node.

    Every round maps each node to its smallest neighbour, or itself, and that to its own, and then
    contracts the links: those inside a merged node vanish, the others shrink to one for each pair.
    Rounds end when no link is left. What a round makes is checkpointed. Links may repeat; links of a
    node with itself give a component of one; no links give no rows.
    """
    names = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(ordered_pairs(links, "a", "b"))
    labels = cut(names.withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        step = cut(lowest.join(lowest.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"))
        labels = cut(labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        at = lambda c: step.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))
        edges = cut(ordered_pairs(edges.join(at("a"), "a").join(at("b"), "b"), "top_a", "top_b"))
    return labels
