"""Codebook-quality metrics of assigned code tuples.

Input frames have ``ids ARRAY<INT>`` (codes in [0, range), -1 for unknown) and grouping columns
such as ``category``. Everything starts from tuple counts: one aggregation with map-side
combining, after which the data has the size of the distinct tuples. These are set-level
statistics; values of parts must never be averaged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.workspace import store

ALL = "*"
TOP_SHARED = 20


def tuple_counts(codes: DataFrame, size: int, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """``keys, ids, n``: items per distinct tuple of the first ``size`` codes."""
    return (
        codes.select(*keys, F.slice("ids", 1, size).alias("ids"))
        .groupBy(*keys, "ids")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_all(tuples: DataFrame) -> DataFrame:
    """Adds the tuple counts over all categories under the category ``ALL``.

    ``tuples`` is read twice and the result feeds several metrics, so pass a stored table.
    """
    everything = tuples.groupBy("ids").agg(F.sum("n").alias("n"))
    return tuples.unionByName(everything.select(F.lit(ALL).alias("category"), "ids", "n"))


def code_usage(tuples: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """``keys, code, n`` over all positions; unknown codes are left out."""
    return (
        tuples.select(*keys, F.explode("ids").alias("code"), "n")
        .filter(F.col("code") >= 0)
        .groupBy(*keys, "code")
        .agg(F.sum("n").alias("n"))
    )


def _perplexity(usage: DataFrame, keys) -> DataFrame:
    """exp of the entropy, as exp(ln T - sum(n ln n) / T): one pass, no per-row share."""
    total = F.sum("n")
    entropy = F.log(total) - F.sum(F.col("n") * F.log(F.col("n"))) / total
    return usage.groupBy(*keys).agg(
        F.exp(entropy).alias("codebook_perplexity"), F.count(F.lit(1)).alias("active_codes")
    )


def quality(
    tuples: DataFrame,
    code_range: int,
    keys: tuple[str, ...] = ("category",),
    groups: DataFrame | None = None,
) -> DataFrame:
    """One row per group: perplexity, active and dead codes, collisions, uniqueness, sharing.

    The column names are fixed values, equal to the reference's metric names.
    A group without items or without any known code scores 0 everywhere and counts all codes as
    dead, while its number of items is kept. ``groups`` names groups to report even when empty.
    """
    keys = list(keys)
    per_tuple = tuples.groupBy(*keys).agg(
        F.sum("n").alias("num_items"),
        F.count(F.lit(1)).alias("num_unique_ids"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("_collided"),
        F.max("n").alias("max_sharing"),
    )
    if groups is not None:
        per_tuple = groups.select(*keys).distinct().join(per_tuple, keys, "left")
    joined = per_tuple.join(_perplexity(code_usage(tuples, keys), keys), keys, "left")
    known = F.col("active_codes").isNotNull()
    zero = F.lit(0).cast("bigint")

    def when_known(value, otherwise):
        return F.when(known, value).otherwise(otherwise)

    items = F.col("num_items")
    return joined.select(
        *keys,
        when_known(F.col("codebook_perplexity"), F.lit(0.0)).alias("codebook_perplexity"),
        when_known(F.col("active_codes"), zero).alias("active_codes"),
        when_known(code_range - F.col("active_codes"), F.lit(code_range)).alias("dead_codes"),
        when_known(F.col("active_codes") / code_range, F.lit(0.0)).alias("active_code_ratio"),
        when_known(F.col("_collided") / items, F.lit(0.0)).alias("collision_rate"),
        when_known(F.col("num_unique_ids") / items, F.lit(0.0)).alias("uniqueness"),
        when_known(F.col("num_unique_ids"), zero).alias("num_unique_ids"),
        F.coalesce(items, zero).alias("num_items"),
        F.coalesce(F.col("max_sharing"), zero).alias("max_sharing"),
    )


def whole_quality(codes: DataFrame, size: int, code_range: int) -> DataFrame:
    """One row of quality metrics over all items; also for no items at all."""
    spark = codes.sparkSession
    tuples = store(tuple_counts(codes, size, ()).withColumn("category", F.lit(ALL)), "tuples")
    one = spark.range(1).select(F.lit(ALL).alias("category"))
    return quality(tuples, code_range, groups=one)


def multiplicity_histogram(tuples: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """``keys, sharing, num_tuples``: how many tuples are shared by so many items."""
    return tuples.groupBy(*keys, F.col("n").alias("sharing")).agg(
        F.count(F.lit(1)).alias("num_tuples")
    )


def most_shared(tuples: DataFrame, top: int = TOP_SHARED) -> DataFrame:
    """The ``top`` tuples per category by count, ties by ascending tuple, with their ``place``.

    Spark keeps only ``top`` rows per category in each task before it shuffles.
    """
    order = W.partitionBy("category").orderBy(F.desc("n"), "ids")
    return tuples.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def position_histogram(tuples: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """``keys, pos, code, n`` with unknown codes included; positions start at 0."""
    return (
        tuples.select(*keys, F.posexplode("ids").alias("pos", "code"), "n")
        .groupBy(*keys, "pos", "code")
        .agg(F.sum("n").alias("n"))
    )


def position_bars(histogram: DataFrame, size: int, code_range: int) -> DataFrame:
    """Chart data: every code 0..range-1 at every position of each category, 0 where unused."""
    axis = (
        histogram.select("category")
        .distinct()
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(code_range - 1))))
    )
    joined = axis.join(histogram, ["category", "pos", "code"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def batch_health(codes: DataFrame, size: int, code_range: int, batch: str = "batch_id") -> DataFrame:
    """Per batch: pooled perplexity, share of the codebook touched, distinct tuples per item.

    The first two look at all codes of a row, the last only at the first ``size``.
    """
    rows = store(codes.groupBy(batch, "ids").agg(F.count(F.lit(1)).alias("n")), "batch-tuples")
    usage = _perplexity(code_usage(rows, (batch,)), [batch])
    cut = rows.groupBy(batch, F.slice("ids", 1, size).alias("ids")).agg(F.sum("n").alias("n"))
    unique = cut.groupBy(batch).agg(
        (F.count(F.lit(1)) / F.sum("n")).alias("uniqueness"), F.sum("n").alias("num_items")
    )
    return unique.join(usage, batch, "left").select(
        batch,
        "num_items",
        F.coalesce("codebook_perplexity", F.lit(0.0)).alias("perplexity"),
        (F.coalesce("active_codes", F.lit(0)) / code_range).alias("diversity"),
        "uniqueness",
    )


def position_perplexity(codes: DataFrame, size: int, batch: str = "batch_id") -> DataFrame:
    """Per batch and position: perplexity of the known codes there, 0 when there is none."""
    histogram = store(position_histogram(tuple_counts(codes, size, (batch,)), (batch,)), "histogram")
    known = _perplexity(histogram.filter(F.col("code") >= 0), [batch, "pos"])
    every = histogram.select(batch, "pos").distinct()
    return every.join(known, [batch, "pos"], "left").select(
        batch, "pos", F.coalesce("codebook_perplexity", F.lit(0.0)).alias("perplexity")
    )
