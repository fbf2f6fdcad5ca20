"""Dense positions and running totals that never put a whole group into one task.

``Window.partitionBy(group)`` sorts each group in a single task, so a user or category that
holds a third of the rows would be one task's work. The helpers here give the same numbers as
``row_number`` and a running ``sum`` while splitting such groups over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.hashing import hash_key
from tesserae.workspace import store

HOT_ROWS = 1_000_000
BUCKET_ROWS = 20_000
# So many digits make at most 256 buckets a group, which one task sums.
FLAT_DIGITS = 2
SLOTS = 4096


def hash_rank(
    df: DataFrame,
    seed,
    key: list[str],
    group: list[str] = (),
    name: str = "rank",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """1-based position in seeded-shuffle order inside ``group``; ``key`` must identify a row.

    Rows are bucketed by the leading digest digits. Buckets are uniform whatever the data looks
    like and ordered like the digests, so a bucket's first position is the number of rows in the
    buckets before it. Rows are stored once and counted from the stored table; unless ``digits``
    is given there are so many that a bucket of the largest group has about ``BUCKET_ROWS`` rows.
    ``total`` names a column that receives the group's row count.
    """
    group, key = list(group), list(key)
    hashed = store(df.withColumn("_h", hash_key(seed, *group, *key)), "hashed")
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, hashed.count() / BUCKET_ROWS), 16)))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = _bucket_starts(sizes, group, digits)
    local = W.partitionBy(*group, "_b").orderBy("_h", *key)
    ranked = (
        hashed.withColumn("_i", F.row_number().over(local))
        .join(starts, [*group, "_b"])
        .withColumn(name, F.col("_start") + F.col("_i"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_h", "_b", "_i", "_start", "_total")


def _bucket_starts(sizes: DataFrame, group: list[str], digits: int) -> DataFrame:
    """``_start``, rows in the buckets before one, and ``_total``, those of the group.

    Many buckets are summed in two levels, by their first digits and inside of these, so that no task
    holds more than about the root of their number.
    """
    if digits <= FLAT_DIGITS:
        return _starts(sizes, group, "_b")
    cut = sizes.withColumn("_o", F.substring("_b", 1, digits // 2))
    outer = _starts(cut.groupBy(*group, "_o").agg(F.sum("_n").alias("_n")), group, "_o")
    inner = _starts(cut, [*group, "_o"], "_b").withColumnRenamed("_start", "_inner").drop("_total")
    both = inner.join(outer, [*group, "_o"])
    return both.select(*group, "_b", (F.col("_start") + F.col("_inner")).alias("_start"), "_total")


def _starts(sizes: DataFrame, group: list[str], bucket: str) -> DataFrame:
    whole = W.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy(bucket)) - F.col("_n")
    return sizes.select(*group, bucket, before.alias("_start"), F.sum("_n").over(whole).alias("_total"))


def positions(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    within: DataFrame | None = None,
) -> DataFrame:
    """1-based position inside ``group`` by ``order``, which must be unique inside a group.

    Groups up to ``hot_rows`` rows are numbered by a plain window. Larger ones are range
    partitioned on (group, order) and numbered piece by piece. ``df`` is read up to three times,
    so pass a stored table, whose row count is known without reading it, or name one ``within`` which all
    rows of ``df`` lie: if no group of that one is large, ``df`` is read once.
    """
    local = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint")
    if _surely_small(df if within is None else within, group, hot_rows):
        return df.withColumn(name, local)
    df = df if within is None else store(df, "placed")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).drop("_n")
    if hot.isEmpty():
        return df.withColumn(name, local)
    hot = store(hot, "hot-groups")
    cold_rows = df.join(hot, group, "left_anti").withColumn(name, local)
    hot_rows_df = df.join(hot, group, "left_semi")
    return cold_rows.unionByName(_range_positions(hot_rows_df, group, order, name))


def _surely_small(df: DataFrame, group: list[str], hot_rows: int) -> bool:
    """Whether no group can have over ``hot_rows`` rows, from counts that many groups share and few rows shuffle."""
    if df.count() <= hot_rows:
        return True
    slots = df.groupBy(F.pmod(F.xxhash64(*group), F.lit(SLOTS)).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return slots.agg(F.max("_n")).first()[0] <= hot_rows


def _range_positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    placed = store(
        df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()),
        "range-placed",
    )
    sizes = placed.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select(*group, "_pid", F.sum("_n").over(earlier).alias("_start"))
    # A range partition continues at most one group, so there are fewer such rows than
    # partitions: a proven bound for the broadcast.
    carried = carried.filter(F.col("_start").isNotNull())
    piece = W.partitionBy(*group, "_pid").orderBy(*order)
    return (
        placed.withColumn("_i", F.row_number().over(piece).cast("bigint"))
        .join(F.broadcast(carried), [*group, "_pid"], "left")
        .withColumn(name, F.col("_i") + F.coalesce("_start", F.lit(0)))
        .drop("_pid", "_i", "_start")
    )


def running_start(
    df: DataFrame, group: list[str], index: str, value: str, name: str, block: int = 4096
) -> DataFrame:
    """Sum of ``value`` over the rows of the group with a smaller ``index`` (dense integers).

    Dense indexes are cut into equal blocks: one small window over block sums, one over rows
    inside a block.
    """
    blocked = df.withColumn("_b", F.floor((F.col(index) - 1) / block))
    sums = blocked.groupBy(*group, "_b").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    before = F.sum("_s").over(W.partitionBy(*group).orderBy("_b")) - F.col("_s")
    starts = sums.select(*group, "_b", before.alias("_start"))
    inside = F.sum(value).over(W.partitionBy(*group, "_b").orderBy(index)) - F.col(value)
    return (
        blocked.withColumn("_i", inside)
        .join(starts, [*group, "_b"])
        .withColumn(name, F.col("_start") + F.col("_i"))
        .drop("_b", "_i", "_start")
    )
