"""Benign and harmful collisions: items that share a code tuple, split by a table of pairs that may.

Two items that are nearly the same may share a tuple; unrelated ones should not. Pairs inside a
tuple are counted, never formed: n items make n(n - 1)/2 pairs. The pairs that may collide are
counted from their own table, with one lookup of the codes per end, so a tuple that holds a third of
all items costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.workspace import store


def coded_items(codes: DataFrame, item: str, keys: tuple[str, ...], size: int) -> DataFrame:
    """``keys, item, ids``: every item once; of an item with several tuples the smallest counts."""
    rows = codes.select(*keys, item, F.slice("ids", 1, size).alias("ids")).dropna(subset=[item, "ids"])
    return rows.groupBy(*keys, item).agg(F.min("ids").alias("ids"))


def benign_pairs(coded: DataFrame, pairs: DataFrame, item: str, keys: tuple[str, ...], first: str, second: str) -> DataFrame:
    """``keys, ids, benign``: distinct unordered pairs of different items of the table that share a tuple."""
    ends = pairs.filter(F.col(first) != F.col(second)).select(
        *keys, F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b")
    )
    one = coded.select(*keys, F.col(item).alias("_a"), "ids")
    other = coded.select(*keys, F.col(item).alias("_b"), "ids")
    both = ends.distinct().join(one, [*keys, "_a"]).join(other, [*keys, "_b", "ids"])
    return both.groupBy(*keys, "ids").agg(F.count(F.lit(1)).alias("benign"))


def tuple_collisions(
    codes: DataFrame, pairs: DataFrame, size: int, item: str = "item", keys: tuple[str, ...] = (),
    first: str = "first", second: str = "second",
) -> DataFrame:
    """``keys, ids, n, pairs, benign, harmful`` per tuple that two or more items share.

    ``pairs`` names items that may collide, in either order, inside the same ``keys``. Unknown items,
    repeated pairs and pairs of an item with itself change nothing.
    """
    coded = store(coded_items(codes, item, keys, size), "coded-items")
    shared = coded.groupBy(*keys, "ids").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    benign = benign_pairs(coded, pairs, item, keys, first, second)
    total = F.col("n") * (F.col("n") - 1) / 2
    zero = F.lit(0).cast("bigint")
    return (
        shared.join(benign, [*keys, "ids"], "left")
        .withColumn("pairs", total.cast("bigint"))
        .withColumn("benign", F.coalesce("benign", zero))
        .withColumn("harmful", F.col("pairs") - F.col("benign"))
        .select(*keys, "ids", "n", "pairs", "benign", "harmful")
    )


def collision_split(
    codes: DataFrame, pairs: DataFrame, size: int, item: str = "item", keys: tuple[str, ...] = (),
    first: str = "first", second: str = "second",
) -> DataFrame:
    """One row per group of items: pairs that collide, how many are benign or harmful, and their rates.

    ``harmful_items`` is the number of items in tuples with a harmful pair; rates are shares of all
    items' pairs that collide (``harmful_rate``) and of the items (``harmful_item_rate``).
    """
    coded = store(coded_items(codes, item, keys, size), "coded-items")
    tuples = tuple_collisions(coded, pairs, size, item, keys, first, second)
    sums = tuples.groupBy(*keys).agg(
        F.sum("pairs").alias("pairs"),
        F.sum("benign").alias("benign"),
        F.sum("harmful").alias("harmful"),
        F.sum(F.when(F.col("harmful") > 0, F.col("n")).otherwise(0)).alias("harmful_items"),
    )
    items = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_items"))
    one = F.lit(0).alias("_all")
    joined = items.select("*", one).join(sums.select("*", one), [*keys, "_all"], "left")
    zero = F.lit(0).cast("bigint")
    filled = joined.select(
        *keys, "num_items", *[F.coalesce(c, zero).alias(c) for c in ("pairs", "benign", "harmful", "harmful_items")]
    )
    return filled.select(
        "*",
        F.when(F.col("pairs") > 0, F.col("harmful") / F.col("pairs")).otherwise(F.lit(0.0)).alias("harmful_rate"),
        F.when(F.col("num_items") > 0, F.col("harmful_items") / F.col("num_items")).otherwise(F.lit(0.0)).alias("harmful_item_rate"),
    )
