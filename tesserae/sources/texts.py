"""Raw product texts given as arguments and as a line file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import strip
from tesserae.operators.ranking import positions
from tesserae.sources.files import read_lines
from tesserae.workspace import store


def read_texts(
    spark: SparkSession,
    texts: list[str] | None = None,
    path: str | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """``index, product_text``: arguments as they are, then stripped file lines; blank ones drop.

    ``index`` is the 0-based place; ``max_samples`` keeps a prefix (0 keeps none).
    """
    given = [("", 0, i, t) for i, t in enumerate(texts or []) if t.strip()]
    frame = spark.createDataFrame(given, "file string, start bigint, line bigint, product_text string").select(
        F.lit(0).alias("source"), F.struct("file", "start", "line").alias("seq"), "product_text"
    )
    if path:
        lines = read_lines(spark, path, "text file").select(
            F.lit(1).alias("source"), "seq", strip("value").alias("product_text")
        )
        frame = frame.unionByName(lines.filter("product_text <> ''"))
    tagged = store(frame.withColumn("all", F.lit(0)), "texts")
    placed = positions(tagged, ["all"], ["source", "seq"], "index")
    placed = placed.select((F.col("index") - 1).alias("index"), "product_text")
    return placed if max_samples is None else placed.filter(F.col("index") < max_samples)
