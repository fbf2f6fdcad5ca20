"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.workspace import store


def connect(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of the links (``a``, ``b``).

    Both rounds hang neighbours on the smallest node in reach and never gather a neighbourhood in
    one task: the smallest neighbour is a combined aggregate, joined back to the links. The links
    are stored after each round; rounds end when every node hangs directly on a root, which takes
    a number of rounds in the order of the logarithm of the nodes. Self links and repeated links
    are ignored; an empty table gives an empty result.
    """
    links = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = store(links.distinct(), "links")
    while True:
        links = store(small_star(large_star(links)), "links")
        # Done when no node hangs on two and no root hangs on another node.
        twice = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        inner = links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi").limit(1)
        if not twice.unionByName(inner.withColumn("n", F.lit(0).cast("bigint"))).take(1):
            break
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour, itself included."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter(F.col("u") != F.col("v")).distinct()
