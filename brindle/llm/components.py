"""Connected components of a table of links, by stars that are drawn towards the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import forget, join_hot, stored


def _normal(edges: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(node, root) of every node that is linked with another; root is the component's smallest node.

    edges has columns a and b of one ordered type; links with a null or with oneself are ignored.
    Each round links every node with the smallest of its smaller neighbours, links those neighbours
    with it too, and then goes one step further down; rounds are written to the shared folder, and
    their number grows with the logarithm of the longest chain. Nothing but counts comes to the driver.
    scratch gets the stored table that the result reads.
    """
    now = stored(_normal(edges), "links")
    while True:
        by = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if by.where("n > 1").isEmpty() and now.join(by.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            if scratch is not None:
                scratch.append(now)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        pairs = now.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = stored(_normal(pairs), "stars")
        below = stars.groupBy("a").agg(F.min("b").alias("m"))
        weights = stars.groupBy("b").agg(F.count(F.lit(1)).alias("weight"))
        steps = below.select(F.col("a").alias("b"), "m").join(weights, "b")
        moved = join_hot(stars, steps, "b", "weight", stars.count(), how="left")
        now, old = stored(_normal(moved.select("a", F.coalesce("m", "b").alias("b"))), "links"), now
        forget(old, stars)
