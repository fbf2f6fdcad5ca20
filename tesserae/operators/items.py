"""Product metadata: normalisation, alignment with the k-core items, text and prompts.

A metadata frame has ``category, asin, title, description, categories, brand`` and ``seq``, an
orderable input position that is unique inside a category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions.hashing import unit
from tesserae.functions.prompts import TEMPLATES, guessing_prompt, reconstruction_prompt

# Field orders and defaults that must equal the reference's.
NAME_FIELDS = ("title", "product_title", "name")
FEATURE_FIELDS = ("features", "description", "details", "categories")
CODEBOOK_SIZE = 6
CODEBOOK_RANGE = 99
MAX_CHARS = 600
FEATURE_PROBABILITY = 0.5
SPLIT_SEED = 42


def _text(df: DataFrame, name: str):
    return tx.stringify(name, df.schema[name].dataType)


def normalize(metadata: DataFrame, keep: tuple[str, ...] = ("category", "seq")) -> DataFrame:
    """Ragged metadata onto ``asin, title, description, categories, details``; rows are kept as is."""
    brand = tx.clean(_text(metadata, "brand"))
    paths = tx.flatten_paths("categories", metadata.schema["categories"].dataType)
    return metadata.select(
        *keep,
        _text(metadata, "asin").alias("asin"),
        tx.clean(_text(metadata, "title")).alias("title"),
        tx.clean(_text(metadata, "description")).alias("description"),
        paths.alias("categories"),
        tx.brand_details(brand).alias("details"),
    )


def align(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """Metadata rows of the allowed items; ``items`` has ``category, item``."""
    allowed = items.select("category", F.col("item").alias("asin"))
    return metadata.join(allowed, ["category", "asin"], "left_semi")


def latest(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """One row per allowed asin: the values of its last record, with ``item_order`` of its first."""
    values = [c for c in metadata.columns if c not in ("category", "asin", "seq")]
    return (
        align(metadata, items)
        .groupBy("category", "asin")
        .agg(
            F.max_by(F.struct(*values), "seq").alias("_last"),
            F.min("seq").alias("item_order"),
        )
        .select("category", "asin", "item_order", "_last.*")
    )


def with_text(
    items: DataFrame,
    index: str = "index",
    seed: int = SPLIT_SEED,
    max_chars: int = MAX_CHARS,
    probability: float = FEATURE_PROBABILITY,
) -> DataFrame:
    """Adds ``product_name, product_features, product_text``.

    Features are included when there are any and the row's uniform draw, keyed by seed plus
    position in the split, is below ``probability``.
    """
    names = [tx.clean(_text(items, c)) for c in NAME_FIELDS if c in items.columns]
    chunks = [tx.clean(_text(items, c)) for c in FEATURE_FIELDS if c in items.columns]
    features = tx.product_features(chunks) if chunks else F.array().cast("array<string>")
    named = items.withColumn("product_name", tx.product_name(names)).withColumn(
        "product_features", features
    )
    include = (F.size("product_features") > 0) & (unit("coin", F.col(index) + seed) < probability)
    return named.withColumn(
        "product_text", tx.product_text("product_name", "product_features", include, max_chars)
    )


def with_prompts(
    items: DataFrame,
    index: str = "index",
    size: int = CODEBOOK_SIZE,
    code_range: int = CODEBOOK_RANGE,
    templates: tuple[str, ...] = TEMPLATES,
) -> DataFrame:
    """Adds the two chats of a prompt record to items that have ``product_text``."""
    return items.withColumn(
        "guessing_prompt", guessing_prompt("product_text", index, size, code_range, templates)
    ).withColumn("reconstruction_prompt", reconstruction_prompt("product_text", size, code_range))
