"""Components of graphs whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of ``edges(u, v)`` reaches.

    Each round takes the least root among the neighbours and then the root's root; every
    round is written to the shared folder, so it neither grows the lineage nor the driver.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("heard"))
        next_ = written(labels.join(heard, labels.node == heard.u, "left").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root")))
        up = next_.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = written(next_.join(up, next_.root == up.at, "left").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("was")).alias("moved")))
        discard(labels, next_)
        labels = jumped
        if jumped.where("moved").isEmpty():
            discard(both)
            return labels.select("node", "root")
