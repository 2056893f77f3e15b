"""Connected components of very many links, by spreading the least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.session import cut_lineage


def components(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, node, group): the least node that links of (key, a, b) reach from each node of (key, node).

    In each round a node takes the least label of its neighbours and what that label's own node has
    reached (which halves the way that is left), until nothing changes. Each round is one
    shuffle by key and node, combined map-side, and is materialised; links and labels are never gathered.
    Nodes without links are groups of their own; links of unknown nodes don't count.
    """
    both = cut_lineage(links.select(key, "a", "b").unionByName(links.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut_lineage(nodes.select(key, "node", F.col("node").alias("group")).distinct())
    while True:
        heard = both.join(label.select(key, F.col("node").alias("b"), F.col("group").alias("_h")), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("_h").alias("_h"))
        least = label.join(heard, [key, "node"], "left").select(key, "node", F.col("group").alias("_was"), F.least("group", F.coalesce("_h", "group")).alias("_to"))
        jump = label.select(key, F.col("node").alias("_to"), F.col("group").alias("_j"))
        following = cut_lineage(least.join(jump, [key, "_to"], "left").select(key, "node", "_was", F.least("_to", F.coalesce("_j", "_to")).alias("group")))
        label = following.select(key, "node", "group")
        if following.where(F.col("_was") != F.col("group")).isEmpty():
            return label
