"""Product metadata in JSON or Parquet with a declared schema, one source per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tesserae.sources.files import existing, row_order, union_categories

# Field names that must equal the reference's.
PRODUCT_SCHEMA = (
    T.StructType()
    .add("title", T.StringType())
    .add("product_title", T.StringType())
    .add("name", T.StringType())
    .add("features", T.ArrayType(T.StringType()))
    .add("description", T.ArrayType(T.StringType()))
    .add("details", T.StringType())
    .add("categories", T.ArrayType(T.StringType()))
)


def read_products(
    spark: SparkSession,
    paths: dict[str, str],
    format: str = "json",
    schema: T.StructType = PRODUCT_SCHEMA,
) -> DataFrame:
    """``category, seq`` and the declared fields; absent ones are null."""
    reader = spark.read.schema(schema).format(format)
    frames = {
        c: existing(reader.load, p, f"products of '{c}'").select(row_order().alias("seq"), *schema.names)
        for c, p in paths.items()
    }
    return union_categories(frames)
