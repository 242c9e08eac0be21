"""Connected components of a link table by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(links: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """``links(a, b)`` of longs -> ``node, comp``: the least node within reach.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so chains shorten by half; rounds end when no
    label changes.  Labels are written each round, so a lost executor costs one
    round at most, and those of the round before are removed.  Nodes without
    links have no row.
    """
    shelf = shelf or Shelf(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = shelf.put(both.where("a <> b").distinct(), "cc-edges")
    first = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp"))
    labels = shelf.put(first.withColumn("moved", F.lit(True)), "cc-labels")
    while True:
        known = labels.select("node", "comp")
        near = (
            edges.join(known.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        met = known.join(near, "node").select("node", "comp", F.least("comp", "near").alias("met"))
        onward = known.select(F.col("node").alias("met"), F.col("comp").alias("next"))
        least = F.least("met", "next")
        new = shelf.put(met.join(onward, "met").select("node", least.alias("comp"), (least < F.col("comp")).alias("moved")), "cc-labels")
        shelf.drop(labels)
        labels = new
        if not new.where("moved").limit(1).count():
            shelf.drop(edges)
            return labels
