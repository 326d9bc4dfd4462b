"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node of its component.

    Each round hands labels along links (a minimum, combined before the shuffle) and then follows
    labels of labels, so the rounds grow with the logarithm of the longest chain.  Links of a hub
    meet one label row in a plain join, which adaptive execution can split.
    """
    both = tables.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "comp"), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", "comp", F.least("comp", "heard").alias("near"))
        jump = nearer.alias("x").join(labels.select(F.col("node").alias("near"), F.col("comp").alias("far")), "near", "left")
        new = tables.write(jump.select("node", F.col("comp").alias("was"), F.least("near", "far").alias("comp")), "labels")
        tables.drop(labels)
        labels = new
        if labels.where("was <> comp").isEmpty():
            return labels.select("node", "comp")
