"""Connected components of a graph of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b): ``node`` and ``component``, the smallest node it is connected with.

    Each round gives a node the smallest label next to it and then the label of its label, so the number
    of rounds grows with the logarithm of the longest chain. Labels are stored after each round, and every
    join is between stored tables, so that the adaptive join can split a node with very many links.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        .withColumn("component", F.least("node", "component"))
    )
    while True:
        of_b = labels.select(F.col("node").alias("b"), "component")
        near = cut_lineage(both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        spread = cut_lineage(
            labels.join(near, "node").select(
                "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
            )
        )
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut_lineage(
            spread.join(jump, "component").select("node", F.col("further").alias("component"), (F.col("further") < F.col("was")).alias("moved"))
        )
        if labels.where("moved").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
