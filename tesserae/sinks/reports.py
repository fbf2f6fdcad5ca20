"""JSON and JSON-lines outputs of evaluation and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import code_tokens
from tesserae.operators.codes import (
    ALL,
    TOP_SHARED,
    most_shared,
    multiplicity_histogram,
    position_histogram,
    quality,
    tuple_counts,
    with_all,
)
from tesserae.workspace import store


# Fixed value: what precedes the names of metrics in files of whole-split metrics.
METRIC_PREFIX = "eval/"


def metric_row(row: DataFrame) -> DataFrame:
    """A one-row frame of metrics under the names used in files: without grouping and helper columns."""
    names = [c for c in row.columns if c not in ("category", "max_sharing")]
    return row.select(*[F.col(c).alias(METRIC_PREFIX + c) for c in names])


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row frame as a JSON object."""
    row.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


def assignments(rows: DataFrame, ids: str = "semantic_ids") -> DataFrame:
    """``product_name, semantic_ids, semantic_id_tokens``: the corpus-to-code map."""
    return rows.select(
        "product_name", F.col(ids).alias("semantic_ids"), code_tokens(ids).alias("semantic_id_tokens")
    )


def generated(rows: DataFrame) -> DataFrame:
    """``product_text, semantic_ids, semantic_id_tokens, semantic_id_text``."""
    return rows.select("product_text", "semantic_ids", "semantic_id_tokens", "semantic_id_text")


def _ordered_map(key: str, value: str) -> Column:
    """Map in ascending order of integer keys, which JSON spells as strings."""
    entries = F.array_sort(
        F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))),
        lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0),
    )
    return F.map_from_arrays(F.transform(entries, lambda e: e["k"].cast("string")), entries["v"])


def _or_empty(rows: DataFrame, name: str, empty: str = "map()") -> Column:
    return F.coalesce(name, F.expr(empty).cast(rows.schema[name].dataType))


def category_report(
    codes: DataFrame, size: int, code_range: int, top: int = TOP_SHARED, groups: DataFrame | None = None
) -> DataFrame:
    """``category, report`` for every category and ``ALL``: metrics, collapse and histograms.

    ``groups`` names categories to report even when nothing is left of them: their metrics are 0,
    all codes are dead, and their lists and histograms are empty.

    The maps are bounded: positions by codes, ``top`` tuples, and at most sqrt(2 n) different
    sharing counts for n items.
    """
    tuples = store(with_all(store(tuple_counts(codes, size), "tuples")), "tuples")
    keyed = "category"
    sharing = multiplicity_histogram(tuples).groupBy(keyed).agg(
        _ordered_map("sharing", "num_tuples").alias("multiplicity_histogram")
    )
    shared = most_shared(tuples, top).groupBy(keyed).agg(
        F.array_sort(F.collect_list(F.struct("place", "ids", "n"))).alias("_top")
    )
    per_position = position_histogram(tuples).groupBy(keyed, "pos").agg(
        _ordered_map("code", "n").alias("_h")
    )
    histograms = per_position.groupBy(keyed).agg(_ordered_map("pos", "_h").alias("histograms"))
    spark = codes.sparkSession
    wanted = tuples.select(keyed).unionByName(spark.range(1).select(F.lit(ALL).alias(keyed)))
    metrics = quality(tuples, code_range, groups=wanted if groups is None else wanted.unionByName(groups.select(keyed)))
    joined = metrics.join(sharing, keyed, "left").join(shared, keyed, "left").join(histograms, keyed, "left")
    joined = joined.withColumn("multiplicity_histogram", _or_empty(joined, "multiplicity_histogram"))
    joined = joined.withColumn("_top", _or_empty(joined, "_top", "array()"))
    nothing = F.map_from_arrays(
        F.array(*[F.lit(str(p)) for p in range(size)]),
        F.array(*[F.expr("map()").cast(joined.schema["histograms"].dataType.valueType) for _ in range(size)]),
    )
    joined = joined.withColumn("histograms", F.coalesce("histograms", nothing))
    top_list = F.transform("_top", lambda t: F.struct(t["ids"].alias("tuple"), t["n"].alias("count")))
    collapse = F.struct(
        "multiplicity_histogram",
        F.col("max_sharing").alias("max_products_sharing_one_id"),
        top_list.alias("most_shared_ids"),
    )
    scalars = [c for c in metrics.columns if c not in (keyed, "max_sharing")]
    return joined.select(
        keyed,
        F.struct(
            *scalars, collapse.alias("collapse"), F.col("histograms").alias("position_histograms")
        ).alias("report"),
    )


def nested_report(
    reports: DataFrame, categories: list[str], size: int, code_range: int, checkpoint: str | None = None
) -> DataFrame:
    """One row: settings, the ``global`` report and the ``per_category`` ones."""
    entry = F.struct(F.col("category").alias("key"), F.col("report").alias("value"))
    return reports.agg(
        F.lit(checkpoint).cast("string").alias("checkpoint"),
        F.array(*[F.lit(c) for c in categories]).cast("array<string>").alias("categories"),
        F.lit(size).alias("codebook_size"),
        F.lit(code_range).alias("codebook_range"),
        F.first(F.when(F.col("category") == ALL, F.col("report")), ignorenulls=True).alias("global"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("category") != ALL, entry))
        ).alias("per_category"),
    )
