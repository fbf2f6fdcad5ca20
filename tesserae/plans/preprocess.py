"""Review and product logs to sequences, id maps, item attributes and negatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import attributes as at
from tesserae.operators import ids
from tesserae.operators import interactions as it
from tesserae.operators.items import latest
from tesserae.operators.negatives import NEGATIVES, sample_negatives
from tesserae.sinks import artifacts as sink
from tesserae.sources import loose
from tesserae.sources.artifacts import ITEM_TABLE
from tesserae.workspace import store


@dataclass
class Preprocessed:
    """The frames of one run; all keyed by category, ids as integers."""

    users: DataFrame
    items: DataFrame
    encoded: DataFrame
    attributes: DataFrame
    item_attributes: DataFrame
    negatives: DataFrame
    stats: DataFrame
    attribute_stats: DataFrame

    def write(self, root: str) -> None:
        """The four artifacts, plus the id tables as Parquet."""
        sink.write_sequences(self.encoded, root)
        sink.write_negatives(self.negatives, root)
        sink.write_item_attributes(self.item_attributes, root)
        sink.write_id_maps(self.users, self.items, self.attributes, root)
        self.users.write.parquet(f"{root}/user_ids")
        self.items.write.parquet(f"{root}/{ITEM_TABLE}")
        self.attributes.write.parquet(f"{root}/attribute_ids")


def preprocess(
    interactions: DataFrame,
    metadata: DataFrame,
    user_core: int = it.USER_CORE,
    item_core: int = it.ITEM_CORE,
    attribute_core: int = it.ATTRIBUTE_CORE,
    negatives: int = NEGATIVES,
    sample_type: str = "random",
    seed: int = ids.ID_SEED,
) -> Preprocessed:
    """All categories in one run. Frames used more than once are written and scanned again."""
    interactions = store(interactions, "interactions")
    placed = it.sequences(it.kcore(interactions, user_core, item_core), within=interactions)
    core = store(placed.select("category", "user", "item", "pos"), "sequenced")
    users = store(ids.user_ids(core, seed), "user-ids")
    sequenced = store(ids.with_user_ids(core, users), "sequenced")
    items = store(ids.item_ids(sequenced, users), "item-ids")
    encoded = store(ids.encode(sequenced, users, items), "encoded")
    known = store(latest(metadata, items), "latest")
    rows = at.keep_frequent(at.attribute_rows(known), attribute_core)
    names = store(at.attribute_ids(rows), "attribute-ids")
    lists = store(at.item_attributes(known, rows, names, items), "item-attributes")
    return Preprocessed(
        users=users,
        items=items,
        encoded=encoded,
        attributes=names,
        item_attributes=lists,
        negatives=sample_negatives(encoded, negatives, seed, sample_type),
        stats=it.dataset_stats(core, interactions),
        attribute_stats=at.attribute_stats(lists, items),
    )


def preprocess_files(
    spark: SparkSession, categories: list[str], folder: str, out: str, **settings
) -> Preprocessed:
    """Reads the review and metadata files of the categories and writes all artifacts to ``out``."""
    reviews = loose.category_paths(folder, categories, loose.REVIEW_FILE)
    products = loose.category_paths(folder, categories, loose.METADATA_FILE)
    metadata = loose.read_metadata(spark, products)
    result = preprocess(loose.read_interactions(spark, reviews), metadata, **settings)
    result.write(out)
    return result
