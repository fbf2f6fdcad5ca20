"""Dense 1-based ids for users and items, and sequences written with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.interactions import USER
from tesserae.operators.ranking import HOT_ROWS, hash_rank, positions
from tesserae.workspace import store

# Fixed value: default seed that must equal the reference's.
ID_SEED = 2022


def user_ids(interactions: DataFrame, seed: int = ID_SEED) -> DataFrame:
    """``category, user, user_id``: ids in seeded-shuffle order."""
    return hash_rank(interactions.select(*USER).distinct(), seed, ["user"], ["category"], "user_id")


def with_user_ids(sequenced: DataFrame, users: DataFrame) -> DataFrame:
    """``sequenced`` with ``user_id``, joined unless it is there already; store it if it is used more than once."""
    return sequenced if "user_id" in sequenced.columns else sequenced.join(users, USER)


def item_ids(sequenced: DataFrame, users: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``category, item, item_id``: ids by first appearance, walking users by id and items by ``pos``."""
    first = (
        with_user_ids(sequenced, users)
        .groupBy("category", "item")
        .agg(F.min(F.struct("user_id", "pos")).alias("first"))
    )
    return positions(store(first, "first"), ["category"], ["first"], "item_id", hot_rows).drop("first")


def encode(sequenced: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``category, user_id, pos, item_id`` of each interaction."""
    return (
        with_user_ids(sequenced, users)
        .join(items, ["category", "item"])
        .select("category", "user_id", "pos", "item_id")
    )
