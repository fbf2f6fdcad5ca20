"""Negative items per user: distinct, unseen, uniform or weighted by popularity.

Input is an encoded frame (``category, user_id, pos, item_id``) whose item ids are 1..n in each
category. Each user gets numbered draws with replacement; draws that repeat an item or hit a
seen one are skipped. The next kept item is then distributed over the unseen, unpicked items
by weight, which is the law of drawing without replacement. No (user, item) pairs are
formed other than the draws themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.hashing import unit
from tesserae.operators.ranking import HOT_ROWS, running_start
from tesserae.workspace import store

# Defaults that must equal the reference's.
NEGATIVES = 99
NEGATIVE_SEED = 2022

USER_ID = ["category", "user_id"]
PAIR = ["category", "user_id", "item_id"]
BLOCK = 4096
DRAWS_PER_TASK = 1_000_000
BROADCAST_ITEMS = 250_000


def first_slots(k: int) -> int:
    """Draws before the number grows: enough for nearly every user when the pool is large."""
    return k + k // 4 + 8


def ample_items(k: int) -> int:
    """In a pool of so many items few users need more than ``k`` draws, so these are made first."""
    return 8 * k * first_slots(k)


def _steps(df: DataFrame, first, last, name: str) -> DataFrame:
    """One row per integer in [first, last], generated through arrays of at most BLOCK entries."""
    outer = F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))
    blocks = df.withColumn("_o", outer)
    low = F.greatest(first, F.col("_o") * BLOCK)
    high = F.least(last, F.col("_o") * BLOCK + (BLOCK - 1))
    return blocks.withColumn(name, F.explode(F.sequence(low, high))).drop("_o")


def _weighted_pool(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """Items with the half-open interval of interaction numbers that each one covers."""
    items = seen.groupBy("category", "item_id").agg(F.sum("n").alias("weight"))
    pool = running_start(items, ["category"], "item_id", "weight", "start")
    return pool.join(sizes.select("category", "width"), "category")


def _draw(users: DataFrame, pool: DataFrame | None, small: bool, seed: int, tasks: int) -> DataFrame:
    """``category, user_id, target, got, slot, item_id`` for slots first..slots-1 of each user.

    The user table is small and its draws are many, so it is spread over a given number of tasks:
    adaptive execution would go by its bytes and leave them to one task.
    """
    spread = users.repartition(tasks, *USER_ID)
    slots = _steps(spread, F.col("first"), F.col("slots") - 1, "slot")
    drawn = slots.withColumn("at", F.floor(unit(seed, *USER_ID, "slot") * F.col("mass")))
    if pool is None:
        return drawn.select(*USER_ID, "target", "got", "slot", (F.col("at") + 1).alias("item_id"))
    # Interval lookup as an equi-join: with blocks as wide as the mean weight there are at most
    # two intervals per block on average, whatever the weights.
    blocked = drawn.withColumn("block", F.coalesce(F.floor(F.col("at") / F.col("width")), F.lit(0)))
    hit = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("weight"))
    return (
        blocked.join(_sized(_pool_blocks(pool), small), ["category", "block"])
        .filter(hit)
        .select(*USER_ID, "target", "got", "slot", "item_id")
    )


def _pool_blocks(pool: DataFrame) -> DataFrame:
    first = F.floor(F.col("start") / F.col("width"))
    last = F.floor((F.col("start") + F.col("weight") - 1) / F.col("width"))
    blocks = _steps(pool.withColumn("_f", first).withColumn("_l", last), F.col("_f"), F.col("_l"), "block")
    return blocks.select("category", "block", "item_id", "start", "weight")


def _sized(side: DataFrame, small: bool) -> DataFrame:
    """``side``, at most a few rows per pool item, as the build side of a join with draws.

    Spark takes generated rows for as small as the rows they come from and might broadcast the
    draws, so the choice is made here: broadcast a pool of bounded size, else merge.
    """
    return F.broadcast(side) if small else side.hint("merge")


def _unseen(users: DataFrame, pool: DataFrame | None, small: bool, known: DataFrame, hot_rows: int, seed: int) -> DataFrame:
    """First slot of each drawn item that the user does not know.

    Draws are made where the known pairs of their users lie, so that only users and known pairs, and
    draws that look for an interval in a large pool, are shuffled. Users who know more than
    ``hot_rows`` items are left to a join by pair.
    """
    draws, most = users.agg(F.sum(F.col("slots") - F.col("first")), F.max("own")).first()
    tasks = max(users.sparkSession.sparkContext.defaultParallelism, (draws or 0) // DRAWS_PER_TASK)
    drawn = _draw(users, pool, small, seed, tasks)
    if pool is not None and not small:
        drawn = drawn.repartition(tasks, *USER_ID)
    hot = users.filter(F.col("own") > hot_rows).select(*USER_ID) if (most or 0) > hot_rows else None
    pairs = known if hot is None else known.join(hot, USER_ID, "left_anti")
    both = drawn.unionByName(pairs.select(*PAIR).repartition(tasks, *USER_ID), allowMissingColumns=True)
    first = both.groupBy(*PAIR).agg(
        F.min("slot").alias("slot"), F.max("target").alias("target"), F.max("got").alias("got"),
        F.count(F.when(F.col("slot").isNull(), 1)).alias("_known"),
    )
    first = first.filter("_known = 0").drop("_known")
    return first if hot is None else first.join(known.join(hot, USER_ID, "left_semi"), PAIR, "left_anti")


def _take(candidates: DataFrame, k: int, *order) -> DataFrame:
    """The best candidates in order, placed behind the ``got`` items that the user already has."""
    place = F.row_number().over(W.partitionBy(*USER_ID).orderBy(*order))
    return (
        candidates.withColumn("place", place)
        .filter(F.col("place") <= k)
        .withColumn("neg_pos", (F.col("got") + F.col("place")).cast("int"))
        .filter(F.col("neg_pos") <= F.col("target"))
        .select(*USER_ID, "neg_pos", "item_id")
    )


def _remaining(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Every unseen item of the given users, one block of ids at a time."""
    last_block = F.floor((F.col("items") - 1) / BLOCK)
    blocks = users.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    known = (
        seen.join(users.select(*USER_ID), USER_ID, "left_semi")
        .groupBy(*USER_ID, F.floor((F.col("item_id") - 1) / BLOCK).alias("_b"))
        .agg(F.collect_set("item_id").alias("_known"))
    )
    low = F.col("_b") * BLOCK + 1
    ids = F.sequence(low, F.least(F.col("items"), low + (BLOCK - 1)))
    known_ids = F.coalesce("_known", F.array().cast("array<bigint>"))
    return blocks.join(known, [*USER_ID, "_b"], "left").select(
        *USER_ID, "target", "got", F.explode(F.array_except(ids, known_ids)).alias("item_id")
    )


def sample_negatives(
    encoded: DataFrame, k: int = NEGATIVES, seed: int = NEGATIVE_SEED, mode: str = "random", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``category, user_id, neg_pos, item_id``: min(k, unseen items) negatives for every user.

    Users who are still short get up to four times the slots (in ample pools ``k`` slots come before the
    first ones, with the same picks, as these go by slot); only the new ones are drawn, and
    what they add comes behind what the user has. Once a user's slots reach the number of items in
    the category, what is missing is taken from the user's unseen items in the order of exponential
    clocks (rate = weight), which continues the same law and costs no more than the draws already
    made. The growth factor is part of the law: another factor gives other, equally distributed items.
    """
    if mode not in ("random", "pop"):
        raise ValueError(f"unknown sampling mode {mode!r}")
    pairs = encoded.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    seen = store(pairs, "seen")
    mass = F.sum("n") if mode == "pop" else F.max("item_id")
    sizes = seen.groupBy("category").agg(F.max("item_id").alias("items"), mass.alias("mass"))
    sizes = store(sizes.withColumn("width", F.ceil(F.col("mass") / F.col("items"))), "sizes")
    pool = store(_weighted_pool(seen, sizes), "pool") if mode == "pop" else None
    target = F.least(F.lit(k).cast("bigint"), F.col("items") - F.col("own"))
    users = store(
        seen.groupBy(*USER_ID)
        .agg(F.count(F.lit(1)).alias("own"))
        .join(sizes, "category")
        .withColumn("target", target)
        .filter(F.col("target") > 0)
        .withColumn("first", F.lit(0).cast("bigint"))
        .withColumn("slots", F.when(F.col("items") >= ample_items(k), k).otherwise(first_slots(k)).cast("bigint"))
        .withColumn("got", F.lit(0).cast("bigint")),
        "users",
    )
    small = pool is not None and pool.count() <= BROADCAST_ITEMS
    parts: list[DataFrame] = []
    while True:
        known = seen.select(*PAIR)
        if parts:
            known = known.unionByName(_union(parts).select(*PAIR)).join(users.select(*USER_ID), USER_ID, "left_semi")
        fresh = _unseen(users, pool, small, known, hot_rows, seed)
        parts.append(store(_take(fresh, k, "slot"), "picks"))
        more = parts[-1].groupBy(*USER_ID).agg(F.count(F.lit(1)).alias("more"))
        short = users.join(more, USER_ID, "left").withColumn("got", F.col("got") + F.coalesce("more", F.lit(0)))
        short = store(short.filter(F.col("got") < F.col("target")).drop("more"), "short")
        if short.isEmpty():
            return _union(parts)
        spent = short.filter(F.col("slots") >= F.col("items"))
        users = short.filter(F.col("slots") < F.col("items"))
        if users.isEmpty():
            return _union([*parts, _fill(spent, pool, small, seen, _union(parts), seed, k)])
        if not spent.isEmpty():
            parts.append(store(_fill(spent, pool, small, seen, _union(parts), seed, k), "picks"))
        more = F.when(F.col("slots") < first_slots(k), first_slots(k)).otherwise(F.col("slots") * 4).cast("bigint")
        users = users.withColumn("first", F.col("slots")).withColumn("slots", more)


def _fill(users, pool: DataFrame | None, small: bool, seen: DataFrame, picked: DataFrame, seed: int, k: int) -> DataFrame:
    """What the users still miss, from the items that they have neither seen nor been given."""
    rest = _remaining(users, seen).join(picked, PAIR, "left_anti")
    clock = -F.log(1 - unit(seed, F.lit("fill"), *PAIR))
    if pool is not None:
        rest = rest.join(_sized(pool.select("category", "item_id", "weight"), small), ["category", "item_id"])
        clock = clock / F.col("weight")
    return _take(rest.withColumn("_clock", clock), k, "_clock", "item_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def unseen_only(candidates: DataFrame, encoded: DataFrame) -> DataFrame:
    """Candidate (category, user_id, item_id) rows the user has not interacted with.

    Stored pairs take a few bytes each, in memory a hundred times that: a join that goes by the size of
    files would send millions of them to every task.
    """
    return candidates.join(encoded.select(*PAIR).distinct().hint("merge"), PAIR, "left_anti")


def sequence_records(sequences: DataFrame, negatives: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """``item_ids`` and ``neg_items`` of every user with a sequence; users without negatives get none.

    Both sides are chunked frames (``category, user_id, chunk_no, ...``). A chunk that only one
    side has keeps what it holds beside an empty list, so a user may have more items or more
    negatives than the other list has chunks for. ``whole_records`` joins the chunks of a user.
    ``sides`` may hold one row per user with a sequence, whose columns are added; joining it also leaves
    out the users without one, so lists are shuffled once less.
    """
    known = negatives
    if sides is None:
        known = negatives.join(sequences.select(*USER_ID).distinct(), USER_ID, "left_semi")
    joined = sequences.join(known, [*USER_ID, "chunk_no"], "full")
    for side, name in ((sequences, "item_ids"), (negatives, "neg_items")):
        none = F.array().cast(side.schema[name].dataType)
        joined = joined.withColumn(name, F.coalesce(name, none))
    return joined if sides is None else joined.join(sides, USER_ID)


def whole_records(records: DataFrame) -> DataFrame:
    """One record per user, its chunks joined in order; for consumers that hold a user's lists in one row."""

    def merged(name: str):
        chunks = F.array_sort(F.collect_list(F.struct("chunk_no", name)))
        return F.flatten(F.transform(chunks, lambda c: c[name])).alias(name)

    return records.groupBy(*USER_ID).agg(merged("item_ids"), merged("neg_items"))
