"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """Components of the undirected links (a, b) between numbers: (node, comp), comp the smallest of its nodes.

    Each round hangs every component on the smallest component that it has a
    link to and follows the chains twice; links inside a component leave, equal
    ones combine.  The number of rounds grows with the logarithm of the longest
    path.
    """
    left = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("comp"))
    left = left.where("a < b")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("to"))
        for _ in range(2):
            over = up.select(F.col("c").alias("to"), F.col("to").alias("top"))
            up = up.join(over, "to", "left").select("c", F.coalesce("top", "to").alias("to"))
        up = written(up, "hung")
        labels = labels.join(up, labels["comp"] == up["c"], "left").select("node", F.coalesce("to", "comp").alias("comp"))
        a, b = up.select(F.col("c").alias("a"), F.col("to").alias("ta")), up.select(F.col("c").alias("b"), F.col("to").alias("tb"))
        moved = left.join(a, "a").join(b, "b").where("ta <> tb")
        left = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    return written(labels, "labels")
