"""Item attributes from brand and category labels.

Input is one row per item (``items.latest``): ``category, asin, item_order, categories, brand``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.interactions import ATTRIBUTE_CORE
from tesserae.operators.ranking import HOT_ROWS, positions
from tesserae.workspace import store

ATTRIBUTE = ["category", "attribute"]


def without_root(categories: str) -> Column:
    """Labels of all paths in order, each path without its first label."""
    paths = F.coalesce(F.col(categories), F.array().cast("array<array<string>>"))
    return F.flatten(
        F.transform(paths, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
    )


def attribute_rows(items: DataFrame) -> DataFrame:
    """``category, asin, item_order, pos, attribute``: the brand first, duplicates kept."""
    has_brand = F.col("brand").isNotNull() & (F.col("brand") != "")
    brand = F.when(has_brand, F.array("brand")).otherwise(F.array().cast("array<string>"))
    listed = items.select(
        "category", "asin", "item_order", F.concat(brand, without_root("categories")).alias("_all")
    )
    return listed.select("category", "asin", "item_order", F.posexplode("_all").alias("pos", "attribute"))


def attribute_counts(rows: DataFrame) -> DataFrame:
    """How often each attribute occurs."""
    return rows.groupBy(*ATTRIBUTE).agg(F.count(F.lit(1)).alias("n"))


def keep_frequent(rows: DataFrame, attribute_core: int = ATTRIBUTE_CORE) -> DataFrame:
    """Rows whose attribute occurs at least ``attribute_core`` times."""
    if attribute_core <= 1:
        return rows
    rare = attribute_counts(rows).filter(F.col("n") < attribute_core)
    return rows.join(rare, ATTRIBUTE, "left_anti")


def attribute_ids(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``category, attribute, attribute_id, num``: ids by first appearance in item order."""
    first = rows.groupBy(*ATTRIBUTE).agg(
        F.min(F.struct("item_order", "pos")).alias("first"), F.count(F.lit(1)).alias("num")
    )
    numbered = positions(store(first, "first"), ["category"], ["first"], "attribute_id", hot_rows)
    return numbered.select("category", "attribute", "attribute_id", "num")


def item_attributes(
    items: DataFrame, rows: DataFrame, attributes: DataFrame, item_ids: DataFrame
) -> DataFrame:
    """``category, item_id, attribute_ids``: a list per item with metadata, empty when it has none.

    Lists come from a single metadata record, so collecting them is bounded.
    """
    pairs = rows.join(attributes, ATTRIBUTE).groupBy("category", "asin").agg(
        F.array_sort(F.collect_list(F.struct("pos", "attribute_id"))).alias("_pairs")
    )
    keyed = items.select("category", "asin").join(
        item_ids.select("category", F.col("item").alias("asin"), "item_id"), ["category", "asin"]
    )
    none = F.array().cast("array<bigint>")
    return keyed.join(pairs, ["category", "asin"], "left").select(
        "category", "item_id", F.coalesce(F.col("_pairs.attribute_id"), none).alias("attribute_ids")
    )


def attribute_stats(lists: DataFrame, item_ids: DataFrame) -> DataFrame:
    """Per category: attributes, mean attributes per matched item, matched items, items, ratio."""
    per_item = lists.groupBy("category").agg(
        F.avg(F.size("attribute_ids")).alias("avg_attributes"), F.count(F.lit(1)).alias("matched")
    )
    used = lists.select("category", F.explode("attribute_ids").alias("a")).distinct()
    distinct = used.groupBy("category").agg(F.count(F.lit(1)).alias("attributes"))
    totals = item_ids.groupBy("category").agg(F.count(F.lit(1)).alias("items"))
    zero = F.lit(0)
    return (
        totals.join(per_item, "category", "left")
        .join(distinct, "category", "left")
        .select(
            "category",
            F.coalesce("attributes", zero).alias("attributes"),
            F.coalesce("avg_attributes", F.lit(0.0)).alias("avg_attributes"),
            F.coalesce("matched", zero).alias("matched"),
            "items",
            (F.coalesce("matched", zero) / F.col("items")).alias("match_ratio"),
        )
    )
