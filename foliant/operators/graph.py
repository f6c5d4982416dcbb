"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import checkpoint, merging


def components(links: DataFrame) -> DataFrame:
    """``(node, head)``: the smallest node that each node of the links ``(a, b)`` reaches.

    Each round takes the smallest label among neighbours and then the label of that
    label, so that chains shorten by powers; rounds end when no label changes.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("head")))
    while True:
        heard = merging(both, label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("head").alias("m"))
        step = checkpoint(merging(label, heard, label["node"] == heard["a"]).select("node", F.least("head", "m").alias("next"), "head"))
        far = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        label = checkpoint(merging(step, far, "next").select("node", F.col("far").alias("head"), (F.col("far") < F.col("head")).alias("moved")))
        done = label.where("moved").isEmpty()
        label = label.select("node", "head")
        if done:
            return label
