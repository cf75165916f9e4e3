"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop, scratch, sized


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node long, component long): the smallest node that links reach.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path. Only ids move, and each round is a written table.
    Empty links give an empty table; a link of a node to itself makes it a component; nulls are left out.
    """
    links = links.where("a is not null and b is not null")
    n = 2 * links.count()
    both = scratch(sized(links.select("a", "b").union(links.select("b", "a")).distinct(), n), "links")
    labels = scratch(sized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), n), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        after = low.join(up, "low").select("node", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("was")).alias("moved"))
        after = scratch(sized(after, n), "labels")
        drop(labels)
        labels = after
        if after.where("moved").isEmpty():
            drop(both)
            out = after.drop("moved")
            out.scratch_path = after.scratch_path
            return out
