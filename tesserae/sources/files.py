"""Line-oriented files with a reproducible row order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(load, path: str, what: str) -> DataFrame:
    """``load(path)``, with a plain error when the path does not exist."""
    try:
        return load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{what} not found: {path}") from error
        raise


def row_order() -> Column:
    """Input position: file, byte offset of the file split, then row order in the scan task.

    Its order is that of the files' names and of the lines in each, compressed or not, however Spark
    cuts and packs the files. Its values do depend on that, so use it to order rows, not as a key.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_lines(spark: SparkSession, path: str, what: str) -> DataFrame:
    """``seq, value`` of a text file or folder of text files."""
    return existing(spark.read.text, path, what).select(row_order().alias("seq"), "value")


def union_categories(frames: dict[str, DataFrame]) -> DataFrame:
    """Concatenates per-category frames, keeping the category as a column."""
    whole = None
    for category, frame in frames.items():
        tagged = frame.select(F.lit(category).alias("category"), *frame.columns)
        whole = tagged if whole is None else whole.unionByName(tagged)
    if whole is None:
        raise ValueError("no category given")
    return whole
