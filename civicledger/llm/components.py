"""Connected components of a links table, as DataFrame joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import staged


def connected_components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, label) for every node that has a link; label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then follows the label's own
    label, which shortens chains about twofold, until nothing changes. Labels are written to the shared
    folder each round. A node with very many links sends one partial minimum per task.
    """
    both = staged(links.select(F.col(x).alias("u"), F.col(y).alias("v")).filter("u <> v").unionByName(
        links.select(F.col(y).alias("u"), F.col(x).alias("v")).filter("u <> v")).distinct(), "edges")
    label = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = (both.join(label, both["v"] == label["node"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
                .join(label, "node").select("node", F.least("m", "label").alias("next"), F.col("label").alias("was")))
        jump = label.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = staged(near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "was"), "labels")
        label = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return label
