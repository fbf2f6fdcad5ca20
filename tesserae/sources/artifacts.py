"""Readers of the preprocessing artifacts.

Two layouts are understood: one file (or folder of parts) per category and artifact, as
``<root>/<category>/<file>``, and the partitioned folders written by ``sinks.artifacts``, as
``<root>/<artifact>/category=<c>/...``. Both hold the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import strip
from tesserae.sources.files import existing, read_lines, row_order, union_categories

# Artifact file names that must equal the reference's.
SEQUENCES = "sequential_data"
NEGATIVES = "negative_samples"
ID_MAPS = "datamaps"
ITEM_ATTRIBUTES = "item2attributes"
# The table of item ids beside the artifacts.
ITEM_TABLE = "item_ids"
EXTENSION = {SEQUENCES: "txt", NEGATIVES: "txt", ID_MAPS: "json", ITEM_ATTRIBUTES: "json"}


def artifact_lines(
    spark: SparkSession, root: str, artifact: str, categories: list[str], partitioned: bool = True
) -> DataFrame:
    """``category, chunk_no, seq, value`` of the wanted categories."""
    if not partitioned:
        name = f"{artifact}.{EXTENSION[artifact]}"
        frames = {c: read_lines(spark, f"{root}/{c}/{name}", f"{artifact} of '{c}'") for c in categories}
        return union_categories(frames).withColumn("chunk_no", F.lit(0).cast("bigint"))
    reader = spark.read.schema("value string, category string, chunk_no bigint")
    for category in categories:
        existing(spark.read.text, f"{root}/{artifact}/category={category}", f"{artifact} of '{category}'")
    whole = reader.text(f"{root}/{artifact}")
    return whole.select("category", "chunk_no", row_order().alias("seq"), "value").filter(
        F.col("category").isin(categories)
    )


def token_lists(lines: DataFrame, id_name: str, list_name: str) -> DataFrame:
    """``"<id> <token> ..."`` lines as rows; lines without a token drop, the last line of an id wins."""
    split = lines.withColumn("value", strip("value")).filter(F.contains("value", F.lit(" ")))
    last = split.groupBy("category", "chunk_no", F.substring_index("value", " ", 1).alias(id_name)).agg(
        F.max_by("value", "seq").alias("_line")
    )
    # Lines are cut after they were shuffled: an array takes many times the bytes of its text.
    tokens = F.split("_line", " ", -1)
    return last.select(
        "category", id_name, "chunk_no", F.slice(tokens, F.lit(2), F.size(tokens) - 1).alias(list_name)
    )


def read_sequences(
    spark: SparkSession, root: str, categories: list[str], partitioned: bool = True
) -> DataFrame:
    """``category, user_id, chunk_no, item_ids`` with ids as strings."""
    lines = artifact_lines(spark, root, SEQUENCES, categories, partitioned)
    return token_lists(lines, "user_id", "item_ids")


def read_negatives(
    spark: SparkSession, root: str, categories: list[str], partitioned: bool = True
) -> DataFrame | None:
    """``category, user_id, chunk_no, neg_items``; None when there are none for any category."""
    found = []
    for category in categories:
        try:
            lines = artifact_lines(spark, root, NEGATIVES, [category], partitioned)
        except FileNotFoundError:
            continue
        found.append(lines)
    if not found:
        return None
    whole = found[0]
    for lines in found[1:]:
        whole = whole.unionByName(lines)
    return token_lists(whole, "user_id", "neg_items")


def read_item_ids(
    spark: SparkSession, root: str, categories: list[str], partitioned: bool = True
) -> DataFrame:
    """``category, item, item_id``; the items are the allow-list of the corpus.

    A whole run also writes them as a table, which is read if it is there; else the id maps are parsed.
    """
    if partitioned:
        try:
            table = existing(spark.read.parquet, f"{root}/{ITEM_TABLE}", "item ids")
            return table.select("category", "item", "item_id").filter(F.col("category").isin(categories))
        except FileNotFoundError:
            pass
    lines = artifact_lines(spark, root, ID_MAPS, categories, partitioned)
    maps = F.from_json("value", "item2id map<string,string>")["item2id"]
    return lines.select("category", F.explode(maps).alias("item", "item_id")).withColumn(
        "item_id", F.col("item_id").cast("bigint")
    )


def read_item_attributes(
    spark: SparkSession, root: str, categories: list[str], partitioned: bool = True
) -> DataFrame:
    """``category, item_id, attribute_ids``."""
    lines = artifact_lines(spark, root, ITEM_ATTRIBUTES, categories, partitioned)
    maps = F.from_json("value", "map<string,array<bigint>>")
    return lines.select("category", F.explode(maps).alias("item_id", "attribute_ids")).withColumn(
        "item_id", F.col("item_id").cast("bigint")
    )
