"""Connected components of a table of links, in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node with a link.

    Each round takes the smallest label among a node's neighbours (a partial minimum, so a node with many
    neighbours is no hot group) and then the label of its label.  Rounds are written to the shared folder.
    Links with a null end are left out; an empty table gives an empty one.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = stored(ends.union(ends.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        lower = own.union(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        parents = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = stored(lower.join(parents, "label").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
