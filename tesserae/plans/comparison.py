"""What learned codes are worth: the same measures for them, for hashed and for random codes of the same items.

No measure of codes means much on its own. A row per source and prefix length puts the quality of the
codebook, the collisions that do harm and the coherence of prefixes side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import prefixes as px
from tesserae.operators.baselines import SEED, hash_ids, random_ids
from tesserae.operators.codes import quality, tuple_counts
from tesserae.operators.collisions import collision_split
from tesserae.operators.ranking import positions
from tesserae.workspace import store

LEARNED, HASHED, RANDOM = "learned", "hash", "random"


def with_baselines(coded: DataFrame, item: str, size: int, code_range: int, seed: int = SEED) -> DataFrame:
    """``source`` and the columns of ``coded``: its rows with their own codes, with hashed and with random ones.

    Items are numbered in their order for the random codes, so that no two share a tuple as long as
    there are enough tuples; items without a tuple of their own then have null codes.
    """
    rows = store(coded, "coded-items")
    names = store(rows.select(item, F.lit(0).alias("_all")).distinct(), "items")
    numbers = positions(names, ["_all"], [item], "_number").select(item, "_number")
    drawn = random_ids(rows.drop("ids").join(numbers, item), "_number", size, code_range, seed, first=1)
    parts = (
        (LEARNED, rows.withColumn("ids", F.slice("ids", 1, size))),
        (HASHED, hash_ids(rows.drop("ids"), [item], size, code_range, seed)),
        (RANDOM, drawn),
    )
    frames = [part.select(F.lit(name).alias("source"), *rows.columns) for name, part in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def compare_codes(
    coded: DataFrame,
    pairs: DataFrame,
    size: int,
    code_range: int,
    item: str = "item",
    label: str = "label",
    vector: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """One row per source of codes and prefix length.

    ``coded`` has an item, its ``ids``, a label and a vector, once per item; ``pairs`` (``first``,
    ``second``) names items that may share a tuple. Columns: ``source, length``; of the prefixes
    ``num_prefixes, purity, entropy, cosine``; of the whole tuples, equal for all lengths, ``codebook_perplexity,
    active_codes, collision_rate, uniqueness, harmful_rate, harmful_item_rate``.
    """
    rows = store(with_baselines(coded, item, size, code_range, seed), "compared-codes")
    by = ("source",)
    known = rows.filter(F.col("ids").isNotNull())
    whole = quality(store(tuple_counts(known, size, by), "tuples"), code_range, by).select(
        "source", "codebook_perplexity", "active_codes", "collision_rate", "uniqueness"
    )
    # Every source has the same pairs.
    asked = pairs.withColumn("source", F.explode(F.array(*map(F.lit, (LEARNED, HASHED, RANDOM)))))
    harm = collision_split(known, asked, size, item, by).select("source", "harmful_rate", "harmful_item_rate")
    purity = px.purity_by_length(px.label_purity(known, size, label, by), by)
    cosine = px.cosine_by_length(px.pair_cosine(known, size, vector, by), by).select("source", "length", "cosine")
    prefix = purity.select("source", "length", "num_prefixes", "purity", "entropy")
    return prefix.join(cosine, ["source", "length"], "left").join(whole, "source").join(harm, "source")
