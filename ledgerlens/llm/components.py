"""Connected components of a table of links, by labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v); nodes have equal labels
    exactly if a path of links joins them. A round takes the least label among
    neighbours, then the label of that label, so paths shrink by half or more;
    rounds end when no label changes. Each round's table is written to the
    shared folder."""
    edges = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        after = least.join(jump, least["label"] == jump["j_node"], "left")
        after = materialize(after.select("node", "old", F.least("label", F.coalesce("j_label", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
