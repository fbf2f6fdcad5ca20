"""Review and product logs with one Python dict literal per line, usually gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.literals import parse_lines
from tesserae.operators.interactions import RATING_FLOOR, rating_filter
from tesserae.sources.files import read_lines, union_categories

# Record keys and file names that must equal the reference's.
REVIEW_FIELDS = (
    T.StructType()
    .add("reviewerID", T.StringType())
    .add("asin", T.StringType())
    .add("overall", T.DoubleType())
    .add("unixReviewTime", T.LongType())
)
METADATA_FIELDS = (
    T.StructType()
    .add("asin", T.StringType())
    .add("title", T.StringType())
    .add("description", T.StringType())
    .add("categories", T.ArrayType(T.ArrayType(T.StringType())))
    .add("brand", T.StringType())
)
REVIEW_FILE = "reviews_{category}_5.json.gz"
METADATA_FILE = "meta_{category}.json.gz"


def read_dicts(
    spark: SparkSession, paths: dict[str, str], fields: T.StructType, what: str = "input file"
) -> DataFrame:
    """``category, seq`` and the declared fields of every line that holds a dict.

    A gzip file is read by one task, so lines are spread over the cluster before the parsing,
    which is the expensive part. ``value`` stays binary: undecodable bytes are dropped later.
    """
    frames = {c: read_lines(spark, p, f"{what} of '{c}'") for c, p in paths.items()}
    lines = union_categories(frames).select(
        "category", "seq", F.col("value").cast("binary").alias("line")
    )
    return parse_lines(lines.repartition("seq"), fields)


def category_paths(folder: str, categories: list[str], template: str) -> dict[str, str]:
    return {c: f"{folder.rstrip('/')}/{template.format(category=c)}" for c in categories}


def read_interactions(
    spark: SparkSession, paths: dict[str, str], floor: float = RATING_FLOOR
) -> DataFrame:
    """``category, user, item, ts, seq`` of rated reviews; rows with a missing or bad field drop."""
    reviews = read_dicts(spark, paths, REVIEW_FIELDS, "reviews")
    for name in REVIEW_FIELDS.names:  # dropna would also drop a NaN rating, which passes the floor
        reviews = reviews.filter(F.col(name).isNotNull())
    return rating_filter(reviews, "overall", floor).select(
        "category",
        F.col("reviewerID").alias("user"),
        F.col("asin").alias("item"),
        F.col("unixReviewTime").alias("ts"),
        "seq",
    )


def read_metadata(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``category, seq`` and the raw product fields."""
    return read_dicts(spark, paths, METADATA_FIELDS, "product metadata")
