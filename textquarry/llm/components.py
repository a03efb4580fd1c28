"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import FEW, staged


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for all nodes of links (a, b): label is the least node reachable.

    Each pass gives a node the least label among its own and its neighbours' and
    then its label's label, so that long chains shrink fast; it ends when a pass
    changes nothing. Nothing but a count of changes reaches the driver. Labels are
    broadcast if there are few links, which leaves one shuffle a pass.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    hint = F.broadcast if edges.limit(FEW + 1).count() <= FEW else lambda df: df
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(hint(labels), edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = near.join(hint(labels), near["a"] == labels["node"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        over = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        passed = staged(new.join(hint(over), "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), "was"))
        done = passed.filter("label != was").isEmpty()
        labels = passed.select("node", "label")
        if done:
            return hint(labels)
