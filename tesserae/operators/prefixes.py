"""Do items whose codes begin alike belong together? Purity of labels and cosine of vectors per code prefix.

Both start with one aggregation over whole tuples and roll its result up to shorter prefixes, so the
items are read once whatever the number of prefix lengths. Items without a label or a usable vector
are left out of the respective figure; tuples shorter than a length have no prefix of it.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.workspace import store


def label_purity(codes: DataFrame, size: int, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length, prefix, n, n_labels, purity, entropy`` per prefix of 1 to ``size`` codes.

    Purity is the share of the most frequent label, entropy that of the labels in nats.
    """
    whole = codes.filter(F.col(label).isNotNull()).select(*keys, F.slice("ids", 1, size).alias("ids"), label)
    counts = store(whole.groupBy(*keys, "ids", label).agg(F.count(F.lit(1)).alias("c")), "label-counts")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.size("ids"), F.lit(size))))
    usable = counts.filter(F.size("ids") > 0).withColumn("length", lengths)
    per_label = (
        usable.withColumn("prefix", F.expr("slice(ids, 1, length)"))
        .groupBy(*keys, "length", "prefix", label)
        .agg(F.sum("c").alias("c"))
    )
    n = F.sum("c")
    entropy = F.log(n) - F.sum(F.col("c") * F.log("c")) / n
    return per_label.groupBy(*keys, "length", "prefix").agg(
        n.alias("n"), F.count(F.lit(1)).alias("n_labels"), (F.max("c") / n).alias("purity"), entropy.alias("entropy")
    )


def purity_by_length(purity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length, num_prefixes, num_items, largest, purity, entropy``: means over items, per prefix length."""
    items = F.sum("n")
    return purity.groupBy(*keys, "length").agg(
        F.count(F.lit(1)).alias("num_prefixes"),
        items.alias("num_items"),
        F.max("n").alias("largest"),
        (F.sum(F.col("n") * F.col("purity")) / items).alias("purity"),
        (F.sum(F.col("n") * F.col("entropy")) / items).alias("entropy"),
    )


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of length 1 instead of ``vector``; null, empty, zero and non-finite ones are left out."""
    wide = rows.withColumn(vector, F.transform(vector, lambda x: x.cast("double")))
    # Components are scaled first, so that squares of very large or small ones stay finite.
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (top > 0)
    scaled = wide.filter(F.coalesce(usable, F.lit(False))).withColumn("_top", top)
    scaled = scaled.withColumn(vector, F.expr(f"transform(`{vector}`, x -> x / _top)"))
    scaled = scaled.withColumn("_norm", F.sqrt(_dot(vector, vector)))
    return scaled.withColumn(vector, F.expr(f"transform(`{vector}`, x -> x / _norm)")).drop("_top", "_norm")


def pair_cosine(codes: DataFrame, size: int, vector: str = "embedding", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length, prefix, n, cosine`` per prefix: the mean cosine over all pairs of its vectors.

    The sum over pairs of unit vectors is (|sum|^2 - n) / 2, so only sums of vectors are grouped;
    no pair is formed. Sums of whole tuples are added up to those of shorter prefixes, one length
    after another. ``cosine`` is null where a prefix has one vector. Tuples must have ``size`` codes;
    vectors must have equal lengths.
    """
    rows = codes.select(*keys, F.slice("ids", 1, size).alias("prefix"), vector).filter(F.size("prefix") == size)
    level = unit_vectors(rows, vector).select(*keys, "prefix", F.lit(1).cast("bigint").alias("n"), vector)
    out = None
    for length in range(size, 0, -1):
        cut = level.withColumn("prefix", F.slice("prefix", 1, length))
        sums = cut.groupBy(*keys, "prefix").agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(vector))).alias(vector)
        )
        level = store(sums, "prefix-sums")
        pairs = F.col("n") * (F.col("n") - 1)
        cosine = F.when(F.col("n") > 1, (_dot(vector, vector) - F.col("n")) / pairs)
        found = level.select(*keys, F.lit(length).alias("length"), "prefix", "n", cosine.alias("cosine"))
        out = found if out is None else out.unionByName(found)
    return out


def cosine_by_length(cosines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length, num_prefixes, num_items, num_pairs, cosine``: the mean over all pairs that share a prefix."""
    pairs = F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.lit(0.0))
    total = F.sum(pairs)
    return cosines.groupBy(*keys, "length").agg(
        F.count(F.lit(1)).alias("num_prefixes"),
        F.sum("n").alias("num_items"),
        total.cast("bigint").alias("num_pairs"),
        F.when(total > 0, F.sum(pairs * F.coalesce("cosine", F.lit(0.0))) / total).alias("cosine"),
    )
