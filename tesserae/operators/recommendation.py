"""Ranking metrics of recommendation lists: Recall@K, Hit@K, NDCG@K and MRR, for all K in one pass.

``ranked`` has a user, an item and a score; ``relevant`` a user, an item and a gain. Columns in
``group`` are part of every key and give one row of metrics each. Defined results:

- An item listed repeatedly counts once, with its best score. Equal scores rank by ascending item,
  null and NaN scores come last; rows without user or item are left out.
- A repeated relevant pair counts once, with its largest gain; pairs without a positive gain are not relevant.
- Users without a relevant item have no recall and take no part in the means; ``num_unjudged`` counts
  those that have a list. Users without a list score 0.
- NDCG is the gain of the hits, each divided by log2(1 + place), against the largest gain that K places can have.
- MRR looks at the whole list, not at K places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.workspace import store

# The cut-offs of the recommendation and of the retrieval protocol.
CUTOFFS = (5, 10, 50, 100)
METRICS = ("recall", "hit", "ndcg")


def _discount(place):
    return 1.0 / F.log2(place + F.lit(1.0))


def best_scores(ranked: DataFrame, user: list[str], item: str = "item", score: str = "score") -> DataFrame:
    """``user, item, score``: every listed item once. Lists shrink before they are shuffled."""
    known = F.when(F.isnan(F.col(score).cast("double")), None).otherwise(F.col(score).cast("double"))
    rows = ranked.select(*user, item, known.alias(score)).dropna(subset=[*user, item])
    return rows.groupBy(*user, item).agg(F.max(score).alias(score))


def positive_gains(relevant: DataFrame, user: list[str], item: str = "item", gain: str = "gain") -> DataFrame:
    """``user, item, gain``: every relevant item once."""
    value = F.col(gain).cast("double") if gain in relevant.columns else F.lit(1.0)
    rows = relevant.select(*user, item, value.alias(gain)).dropna(subset=[*user, item])
    rows = rows.filter((F.col(gain) > 0) & ~F.isnan(gain))
    return rows.groupBy(*user, item).agg(F.max(gain).alias(gain))


def per_user(
    ranked: DataFrame,
    relevant: DataFrame,
    cutoffs: tuple[int, ...] = CUTOFFS,
    user: str = "user",
    item: str = "item",
    score: str = "score",
    gain: str = "gain",
    group: tuple[str, ...] = (),
) -> DataFrame:
    """Per user with relevant items: ``n_relevant``, ``recall_K``, ``hit_K``, ``ndcg_K`` for each K, and ``mrr``.

    Only the first max(K) places of a list take part in the metrics with a cut-off, and Spark keeps
    no more than these per user before it shuffles, so long lists are never sorted in one task. The
    place of the first hit, for MRR, is a count of better items.
    """
    key = [*group, user]
    best = store(best_scores(ranked, key, item, score), "scores")
    wanted = store(positive_gains(relevant, key, item, gain), "relevant")
    last = max(cutoffs)
    by_score = W.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), item)
    top = best.withColumn("_place", F.row_number().over(by_score)).filter(F.col("_place") <= last)
    by_gain = W.partitionBy(*key).orderBy(F.col(gain).desc(), item)
    ideal = wanted.withColumn("_place", F.row_number().over(by_gain)).filter(F.col("_place") <= last)
    worth = F.col(gain) * _discount(F.col("_place"))

    def upto(k, value):
        return F.sum(F.when(F.col("_place") <= k, value))

    hits = top.join(wanted, [*key, item]).groupBy(*key)
    hits = hits.agg(*[e for k in cutoffs for e in (upto(k, F.lit(1)).alias(f"_n{k}"), upto(k, worth).alias(f"_g{k}"))])
    most = ideal.groupBy(*key).agg(*[upto(k, worth).alias(f"_i{k}") for k in cutoffs])
    sizes = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("n_relevant"))
    joined = sizes.join(most, key).join(hits, key, "left").join(_first_hits(best, wanted, key, item, score), key, "left")
    zero = F.lit(0.0)
    columns = [F.coalesce(1.0 / F.col("_first"), zero).alias("mrr")]
    for k in cutoffs:
        n = F.coalesce(F.col(f"_n{k}"), F.lit(0))
        columns += [
            (n / F.col("n_relevant")).alias(f"recall_{k}"),
            (n > 0).cast("double").alias(f"hit_{k}"),
            (F.coalesce(F.col(f"_g{k}"), zero) / F.col(f"_i{k}")).alias(f"ndcg_{k}"),
        ]
    return joined.select(*key, "n_relevant", *columns)


def _first_hits(best: DataFrame, wanted: DataFrame, key: list[str], item: str, score: str) -> DataFrame:
    """Place of each user's first relevant item in the whole list: one more than the items before it."""
    # Structs compare field by field: unscored last, then higher scores, then smaller items.
    rank = F.struct(F.col(score).isNull().alias("u"), (-F.col(score)).alias("s"), F.col(item).alias("i"))
    found = best.join(wanted.select(*key, item), [*key, item]).groupBy(*key).agg(F.min(rank).alias("_best"))
    ahead = best.join(found, key).groupBy(*key)
    return ahead.agg(F.sum((rank <= F.col("_best")).cast("bigint")).alias("_first"))


def ranking_metrics(
    ranked: DataFrame,
    relevant: DataFrame,
    cutoffs: tuple[int, ...] = CUTOFFS,
    user: str = "user",
    item: str = "item",
    score: str = "score",
    gain: str = "gain",
    group: tuple[str, ...] = (),
) -> DataFrame:
    """One row per group and K: ``k, recall, hit, ndcg, mrr, num_users, num_unjudged``, means over the users."""
    key = [*group, user]
    users = store(per_user(ranked, relevant, cutoffs, user, item, score, gain, group), "user-metrics")
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{m}_{k}").alias(m) for m in METRICS]) for k in cutoffs])
    means = (
        users.select(*group, "mrr", F.explode(each).alias("m"))
        .groupBy(*group, "m.k")
        .agg(
            *[F.avg(f"m.{m}").alias(m) for m in METRICS], F.avg("mrr").alias("mrr"), F.count(F.lit(1)).alias("num_users")
        )
    )
    listed = ranked.select(*key).dropna(subset=[user]).distinct()
    unjudged = listed.join(users.select(*key), key, "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("num_unjudged"))
    one = F.lit(0).alias("_all")
    joined = means.select("*", one).join(unjudged.select("*", one), [*group, "_all"], "left").drop("_all")
    return joined.withColumn("num_unjudged", F.coalesce("num_unjudged", F.lit(0).cast("bigint")))
