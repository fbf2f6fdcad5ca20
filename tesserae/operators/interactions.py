"""Interactions: k-core, time-ordered sequences, dataset statistics.

An interaction frame has ``category, user, item, ts`` and ``seq``, a value of any orderable type
that is unique inside a user and gives the input order. Users and items are only comparable
inside a category, so ``category`` is part of every key and all categories share one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranking import HOT_ROWS, positions
from tesserae.workspace import exists, new_path, read_stored, store

USER = ["category", "user"]
ITEM = ["category", "item"]
KEY = ["side", "category", "key"]
SIDES = ("user", "item")
OTHER = {"user": "item", "item": "user"}

# Defaults that must equal the reference's.
RATING_FLOOR = 0.0
USER_CORE = 5
ITEM_CORE = 5
ATTRIBUTE_CORE = 0

CHUNK_ITEMS = 100_000
# Keys per bucket of edges, and the most buckets, whose numbers the driver reads in a round.
BUCKET_KEYS = 500_000
MOST_BUCKETS = 1024
# Rounds that scan the given rows before edges are put into buckets, which costs several such scans.
SCANNED_ROUNDS = 2


def rating_filter(reviews: DataFrame, column: str = "overall", floor: float = RATING_FLOOR) -> DataFrame:
    """Rows rated strictly above the floor. NaN passes, as it does in the reference."""
    return reviews.filter(F.col(column) > floor)


def user_counts(interactions: DataFrame) -> DataFrame:
    """Interactions per user; a repeated pair counts each time."""
    return interactions.groupBy(*USER).agg(F.count(F.lit(1)).alias("n"))


def item_counts(interactions: DataFrame) -> DataFrame:
    """Interactions per item; a repeated pair counts each time."""
    return interactions.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"))


def is_kcore(interactions: DataFrame, user_core: int = USER_CORE, item_core: int = ITEM_CORE) -> DataFrame:
    """One row with ``is_kcore``: every user and item count reaches its core (true if empty)."""
    users = user_counts(interactions).agg((F.min("n") >= user_core).alias("ok"))
    items = item_counts(interactions).agg((F.min("n") >= item_core).alias("ok"))
    both = users.unionByName(items)
    return both.agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("is_kcore"))


def drop_under_core(
    interactions: DataFrame, user_core: int = USER_CORE, item_core: int = ITEM_CORE
) -> DataFrame:
    """One pass: drop under-core users and items, both judged on the counts before the pass."""
    users = user_counts(interactions).filter(F.col("n") < user_core)
    items = item_counts(interactions).filter(F.col("n") < item_core)
    kept = interactions.join(users, USER, "left_anti").join(items, ITEM, "left_anti")
    return kept.select(*interactions.columns)


def kcore(
    interactions: DataFrame, user_core: int = USER_CORE, item_core: int = ITEM_CORE, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """The interactions that remain when passes are repeated until no count is under its core.

    The fixpoint does not depend on the order in which keys are dropped. Counts per user and item
    are kept in one table. A round stores the keys that fell under their core and takes their edges off
    the counts at the other ends. An edge counts against a key only in the round in which its other
    end falls, and keys that fell have left the table, so edges need no rewriting; they are rewritten
    without the fallen ones when much of them went. The first rounds, often the only ones, scan the given
    rows. Later ones read (user, item, n) edges that are stored twice, in buckets of the user's and of
    the item's key, and only the buckets of the keys that fell: a round then reads in proportion to
    these, up to a bucket per fallen key, and writes the size of the counts. ``interactions`` is read
    several times, so pass a stored table.
    """
    spark = interactions.sparkSession
    cores = F.when(F.col("side") == "user", user_core).otherwise(item_core)
    users = user_counts(interactions).select(F.lit("user").alias("side"), "category", F.col("user").alias("key"), "n")
    items = item_counts(interactions).select(F.lit("item").alias("side"), "category", F.col("item").alias("key"), "n")
    counts, folders, rounds, dropped, buckets, whole = users.unionByName(items), [], 0, 0, 1, None
    rows, edges = interactions.select(*USER, "item", F.lit(1).cast("bigint").alias("n")), None
    while True:
        # One write deals the keys into those that fall and those that stay.
        path = new_path(spark, "counts")
        counts.withColumn("fell", F.col("n") < cores).write.partitionBy("fell", "side").parquet(path)
        fell, stayed = f"{path}/fell=true", f"{path}/fell=false"
        some, left = exists(spark, fell), exists(spark, stayed)
        if some:
            folders.append({side: f"{fell}/side={side}" for side in SIDES if exists(spark, f"{fell}/side={side}")})
        if not some:
            return _without(interactions, _keys(counts, folders)) if folders else interactions
        if not left:
            # Every key fell; a null has no equal and so drops no row.
            return interactions.filter("category IS NULL OR (user IS NULL AND item IS NULL)")
        fallen, rest = _keys(counts, folders[-1:]), read_stored(counts, stayed)
        if rounds == 0:
            buckets = min(MOST_BUCKETS, max(1, rest.count() // bucket_keys))
        rounds += 1
        if buckets == 1 or rounds <= SCANNED_ROUNDS:
            whole = interactions.count() if whole is None else whole
            if 2 * (read_stored(counts, fell).agg(F.sum("n")).first()[0] or 0) > whole:
                lost, rows = _split_off(rows, fallen)
                dropped, whole = len(folders), rows.count()
            else:
                lost = _lost({side: rows for side in SIDES}, fallen, 1)
        else:
            held = rest.filter("side = 'user'").agg(F.sum("n")).first()[0] or 0
            if edges is None:
                merged = rows.groupBy(*USER, "item").agg(F.sum("n").alias("n"))
                edges, whole = _bucketed(merged, buckets), held
            elif 2 * held < whole:
                kept = _without(edges["user"].drop("bucket"), _keys(counts, folders[dropped:-1]))
                edges, dropped, whole = _bucketed(kept, buckets), len(folders) - 1, held
            lost = _lost(edges, fallen, buckets)
        counts = rest.join(lost, KEY, "left").select(*KEY, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))


def _keys(counts: DataFrame, folders: list[dict[str, str]]) -> dict[str, DataFrame]:
    """Per side that has any, the fallen keys. Each side is a scan of its own, so its size is known to the joins."""
    found = {}
    for side in SIDES:
        paths = [f[side] for f in folders if side in f]
        if paths:
            found[side] = read_stored(counts.select("category", "key"), *paths).withColumn("side", F.lit(side))
    return found


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64("category", key), F.lit(buckets)).cast("int")


def _bucketed(rows: DataFrame, buckets: int) -> dict[str, DataFrame]:
    """The edges in folders by bucket of their user, and by bucket of their item; one bucket needs one table."""
    rows = store(rows, "edges")
    if buckets == 1:
        one = rows.withColumn("bucket", F.lit(0))
        return {"user": one, "item": one}
    found = {}
    for side in ("user", "item"):
        placed = rows.withColumn("bucket", _bucket(side, buckets))
        path = new_path(rows.sparkSession, f"edges-by-{side}")
        # Rebalancing keeps buckets together and splits those that a hot key fills.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        found[side] = read_stored(placed, path)
    return found


def _touched(edges: dict[str, DataFrame], fallen: DataFrame, side: str, buckets: int) -> DataFrame:
    """Edges whose end on ``side`` fell; only the folders of fallen keys are read."""
    keys = fallen.filter(F.col("side") == side).select("category", F.col("key").alias(side))
    rows = edges[side]
    if buckets > 1:
        hit = keys.select(_bucket(side, buckets).alias("b")).distinct().collect()  # at most MOST_BUCKETS numbers
        rows = rows.filter(F.col("bucket").isin([r["b"] for r in hit]))
    return rows.join(keys, ["category", side], "left_semi")


def _lost(edges: dict[str, DataFrame], fallen: dict[str, DataFrame], buckets: int) -> DataFrame:
    """Per key the edges whose other end fell."""
    return _summed(
        [_touched(edges, keys, side, buckets).withColumnRenamed(OTHER[side], "key").withColumn("side", F.lit(OTHER[side])) for side, keys in fallen.items()]
    )


def _summed(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0].select(*KEY, "n")
    for part in parts[1:]:
        whole = whole.unionByName(part.select(*KEY, "n"))
    return whole.groupBy(*KEY).agg(F.sum("n").alias("lost"))


def _split_off(rows: DataFrame, fallen: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``_lost`` gives, and the edges none of whose ends fell, after one pass over the edges."""
    marked = rows
    for side in SIDES:
        if side in fallen:
            keys = fallen[side].select("category", F.col("key").alias(side), F.lit(True).alias(f"_{side}"))
            marked = marked.join(keys, ["category", side], "left")
        else:
            marked = marked.withColumn(f"_{side}", F.lit(None).cast("boolean"))
    gone = {side: F.col(f"_{side}").isNotNull() for side in SIDES}
    ends = F.when(gone["user"], "user").when(gone["item"], "item").otherwise("none").alias("fell")
    # Edges that lost both ends count for no key that is left.
    marked = marked.filter(~(gone["user"] & gone["item"])).select(*rows.columns, ends)
    path = new_path(rows.sparkSession, "edges")
    marked.write.partitionBy("fell").parquet(path)
    stored = read_stored(marked, path)
    lost = [
        stored.filter(F.col("fell") == side).withColumnRenamed(OTHER[side], "key").withColumn("side", F.lit(OTHER[side])) for side in SIDES
    ]
    return _summed(lost), stored.filter("fell = 'none'").drop("fell")


def _without(rows: DataFrame, fallen: dict[str, DataFrame]) -> DataFrame:
    """Users go last: what follows is mostly a grouping by user, which then needs no shuffle of its own."""
    kept = rows
    for side in reversed(SIDES):
        if side in fallen:
            kept = kept.join(fallen[side].select("category", F.col("key").alias(side)), ["category", side], "left_anti")
    return kept.select(*rows.columns)


def sequences(interactions: DataFrame, hot_rows: int = HOT_ROWS, within: DataFrame | None = None) -> DataFrame:
    """Adds ``pos``: 1-based place of the interaction in its user's time order, input order on ties.

    ``within`` may name a stored table that holds all of ``interactions``, which then need not be stored.
    """
    return positions(interactions, USER, ["ts", "seq"], "pos", hot_rows, within)


def chunked(
    positioned: DataFrame, key: list[str], pos: str, value: str, name: str, chunk: int = CHUNK_ITEMS
) -> DataFrame:
    """Arrays of up to ``chunk`` values per key in ``pos`` order, numbered by ``chunk_no`` from 0.

    A key with more values than that gets several rows, so no row or task holds an unbounded group.
    """
    numbered = positioned.withColumn("chunk_no", F.floor((F.col(pos) - 1) / chunk))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return (
        numbered.groupBy(*key, "chunk_no")
        .agg(pairs.alias("_pairs"))
        .select(*key, "chunk_no", F.col("_pairs.v").alias(name))
    )


def dataset_stats(interactions: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Per category: users, items, interactions, mean sequence length, sparsity in percent.

    ``categories`` names categories to report even when nothing is left of them.
    """
    by_user = user_counts(interactions).groupBy("category").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("interactions")
    )
    by_item = item_counts(interactions).groupBy("category").agg(F.count(F.lit(1)).alias("items"))
    both = by_user.join(by_item, "category")
    if categories is not None:
        both = categories.select("category").distinct().join(both, "category", "left")
    filled = both.select(
        "category",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "items", "interactions")],
    )
    cells = F.col("users").cast("double") * F.col("items")
    return filled.withColumn(
        "avg_len", F.when(F.col("users") > 0, F.col("interactions") / F.col("users"))
    ).withColumn(
        "sparsity", F.when(cells > 0, (1 - F.col("interactions") / cells) * 100).otherwise(F.lit(0.0))
    )


def popularity(encoded: DataFrame) -> DataFrame:
    """Interactions per item id and their share of the category's interactions."""
    counts = encoded.groupBy("category", "item_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("category").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "category").select(
        "category", "item_id", "n", (F.col("n") / F.col("_total")).alias("probability")
    )
