"""Seeded shuffles, train/eval splits and prefix caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranking import hash_rank

# Defaults that must equal the reference's.
SPLIT_SEED = 42
EVAL_RATIO = 0.02


def metadata_eval_size(n: Column, ratio: float) -> Column:
    """Rounded up."""
    return F.ceil(F.lit(float(ratio)) * n)


def sequence_eval_size(n: Column, ratio: float) -> Column:
    """Rounded down, but at least one row."""
    return F.greatest(F.floor(n * F.lit(float(ratio))), F.lit(1).cast("bigint"))


def split(
    rows: DataFrame,
    key: list[str],
    eval_size=metadata_eval_size,
    group: list[str] = (),
    seed: int = SPLIT_SEED,
    ratio: float = EVAL_RATIO,
    max_total: int | None = None,
    max_train: int | None = None,
    max_eval: int | None = None,
) -> DataFrame:
    """Adds ``split`` (train or eval) and ``index``, the 0-based place inside the split.

    Shuffle by digest of ``key`` (which must identify a row), cap the total, cut off the eval
    rows, cap each side. A cap of None or 0 means no cap. With ``group`` every group is shuffled
    and split on its own. ``rows`` is read twice, so pass a stored table when it is costly.
    """
    ranked = hash_rank(rows, seed, key, group, "_place", "_n")
    if max_total:
        ranked = ranked.filter(F.col("_place") <= max_total).withColumn(
            "_n", F.least("_n", F.lit(max_total).cast("bigint"))
        )
    n_eval = eval_size(F.col("_n"), ratio)
    is_eval = F.col("_place") <= n_eval
    placed = ranked.withColumn("split", F.when(is_eval, "eval").otherwise("train")).withColumn(
        "index", F.col("_place") - 1 - F.when(is_eval, F.lit(0)).otherwise(n_eval)
    )
    for side, cap in (("train", max_train), ("eval", max_eval)):
        if cap:
            placed = placed.filter((F.col("split") != side) | (F.col("index") < cap))
    return placed.drop("_place", "_n")


def shuffle(rows: DataFrame, key: list[str], seed: int = SPLIT_SEED, name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in one seeded shuffle over all categories."""
    return hash_rank(rows, seed, key, (), name)


def first_rows(rows: DataFrame, n: int | None, index: str = "index") -> DataFrame:
    """Evaluation cap: rows with ``index < n``. None keeps all rows, 0 keeps none."""
    return rows if n is None else rows.filter(F.col(index) < n)
