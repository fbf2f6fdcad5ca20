"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, and products are exact: where doubles cannot hold them, candidates within
the rounding error of the best are multiplied again in whole numbers. Candidates are dealt into at most
``LEVELS`` ranges of length, and these by digest into buckets of about ``bucket`` vectors. Every query first meets the longest bucket, whose k-th
best product is its threshold. In another bucket that threshold, divided by the query's length and
the bucket's greatest length, is a local cosine threshold: above 1 the bucket holds nothing for
the query. Otherwise the query prunes by length (only vectors long enough to reach the threshold
with a cosine of 1) or, where the local threshold is steep, by coordinate (only vectors whose
normalised value at the query's largest coordinate lies in the interval that a sufficient cosine
allows). What is left is verified by whole products.

Queries come in blocks and meet the buckets in an equi-join on (block, bucket), so a task holds
one block and one bucket, whatever the size of either table. Ranges of length that a query's threshold
puts out of reach are left out before anything is shuffled, and their buckets do not meet blocks that
nobody asks for.

Defined results: vectors that are null, empty or hold a null, NaN or infinite component take no part, nor
do null ids; scaled components beyond ``LARGEST`` count as ``LARGEST``, and scores beyond 64 bits are
ranked exactly but returned as the nearest 64-bit number; vectors of another dimension than a query score 0 on what is missing; a repeated id
counts once, with its smallest vector in array order; ties go to the smaller id; a query gets
fewer than k rows if there are fewer candidates; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.tasks import settled

K = 5
SCALE = 256
BUCKET = 8192
BLOCK = 1024
LEVELS = 64
STEEP = 0.9
HIT = "query_id bigint, vec_id bigint, score decimal(38,0)"
SCORE = pa.decimal128(38)
# Products of 1,000 components of this size still fit into SCORE.
LARGEST = 1 << 58
EXACT = 1 << 53
SAFE = 1e-9


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(``vec_id``, ``x``, ``norm2``) of the vectors that take part, one row per id."""
    largest = F.lit(float(LARGEST))
    scaled = lambda v: F.greatest(F.least(F.lit(float(scale)) * v.cast("double"), largest), -largest)
    x = F.transform(F.col(vector_column), lambda v: F.floor(scaled(v)))
    sound = F.forall(F.col(vector_column), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0))
    rows = rows.filter(sound).select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x"))
    once = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    square = lambda a, v: a + v.cast("double") * v.cast("double")
    return once.withColumn("norm2", F.aggregate("x", F.lit(0.0), square))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of integers; short ones end in zeros."""
    arrays = column.combine_chunks()
    arrays = arrays.chunk(0) if isinstance(arrays, pa.ChunkedArray) else arrays
    sizes = np.asarray(arrays.value_lengths())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(arrays.flatten())
    return out


class Products:
    """Scores of queries with candidates, and whole numbers where a double may round them."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        self.whole_q, self.whole_x = q, x
        self.q, self.x = q.astype(float), x.astype(float)
        largest = (float(np.abs(self.q).max(initial=0)), float(np.abs(self.x).max(initial=0)))
        self.exact = largest[0] * largest[1] * q.shape[1] < EXACT and max(largest) < EXACT
        # Each product and each sum rounds by a share of 2 ** -53 of the lengths' product at most.
        self.share = 0.0 if self.exact else (q.shape[1] + 3) * 2.0**-52

    def best_rows(self, some: np.ndarray, near: np.ndarray, names, ids, lengths, least, k: int) -> list:
        """Per query of ``some`` the k best (score, smaller id) of ``near`` at or above its threshold, without itself."""
        out = []
        scores = self.q[some] @ self.x[near].T
        error = self.share * lengths[0][some] * float(lengths[1][near].max(initial=0))
        ids = ids[near]
        scores[names[some][:, None] == ids[None, :]] = -np.inf
        for i, row, floor, wrong in zip(some, scores, least[some], error):
            if not self.exact and np.isfinite(floor):
                floor -= wrong + abs(floor) * self.share
            if len(row) > k:
                floor = max(floor, np.partition(row, len(row) - k)[len(row) - k] - 2 * wrong)
            hits = np.flatnonzero((row >= floor) & (row > -np.inf))
            if self.exact:
                hits = hits[np.lexsort((ids[hits], -row[hits]))[:k]]
                found = pa.array(row[hits].astype(np.int64)).cast(SCORE)
            else:
                own = self.whole_q[i].astype(object)
                values = {h: int(self.whole_x[near[h]].astype(object) @ own) for h in hits.tolist()}
                hits = np.array(sorted(values, key=lambda h: (-values[h], ids[h]))[:k], np.int64)
                found = pa.array([Decimal(values[h]) for h in hits.tolist()], SCORE)
            out.append((np.full(len(hits), names[i]), ids[hits], found))
        return out


def bucket_products(queries: pa.Table, candidates: pa.Table, k: int, steep: float) -> pa.Table:
    """The k best candidates of one bucket for each query of one block, at or above its threshold."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", SCORE)])
    if not queries.num_rows or not candidates.num_rows:
        return schema.empty_table()
    width = 1
    for table in (queries, candidates):
        width = max(width, int(np.max([np.max(np.asarray(c.value_lengths()), initial=0) for c in table.column("x").chunks])))
    order = np.lexsort((candidates.column("vec_id").to_numpy(), -candidates.column("norm2").to_numpy()))
    ids = candidates.column("vec_id").to_numpy()[order]
    products = Products(matrix(queries.column("x"), width), matrix(candidates.column("x"), width)[order])
    lengths = np.sqrt(candidates.column("norm2").to_numpy()[order])
    unit = products.x / np.maximum(lengths, 1e-300)[:, None]
    names = queries.column("query_id").to_numpy()
    q = products.q
    q_lengths = np.sqrt((q * q).sum(axis=1))
    both = (q_lengths, lengths)
    least = queries.column("threshold").to_numpy(zero_copy_only=False).astype(float)
    found = []
    # Rounding may move a cosine by a few units in the last place; the margins keep pruning safe.
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(np.isneginf(least) | (least <= 0), -1.0, least / (q_lengths * lengths[0]))
    alive = np.flatnonzero(~(cosine > 1 + SAFE))
    pruned = (cosine[alive] >= steep) & (least[alive] > 0)
    dense = alive[~pruned]
    for at in range(0, len(dense), 256):
        own = dense[at : at + 256]
        need = np.where(least[own] > 0, least[own] / np.maximum(q_lengths[own], 1e-300) * (1 - SAFE), 0.0)
        # By length: candidates are sorted, so those that can reach the lowest need come first.
        reach = int(np.searchsorted(-lengths, -need.min(), side="right"))
        found += products.best_rows(own, np.arange(reach), names, ids, both, least, k)
    for i in alive[pruned]:
        focus = int(np.abs(q[i]).argmax())
        along = q[i, focus] / q_lengths[i]
        t = min(cosine[i], 1.0)
        spare = np.sqrt(max((1 - t * t) * (1 - along * along), 0.0))
        low, high = along * t - spare, along * t + spare
        if along >= t:
            high = 1.0
        if along <= -t:
            low = -1.0
        reach = int(np.searchsorted(-lengths, -(least[i] / q_lengths[i] * (1 - SAFE)), side="right"))
        near = np.flatnonzero((unit[:reach, focus] >= low - SAFE) & (unit[:reach, focus] <= high + SAFE))
        found += products.best_rows(np.array([i]), near, names, ids, both, least, k)
    if not found:
        return schema.empty_table()
    names, ids, scores = zip(*found)
    return pa.table([pa.array(np.concatenate(names)), pa.array(np.concatenate(ids)), pa.chunked_array(scores, SCORE)], schema=schema)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def reachable(queries: DataFrame, levels: dict[int, tuple[int, float]]) -> DataFrame:
    """A row per query and range of lengths (``level``, its ``n`` buckets) that may hold its threshold.

    The product with a vector is at most that of the lengths, so a range whose longest vector is too
    short for the threshold holds nothing for the query.
    """
    known = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(n).alias("n"), F.lit(x).alias("longest")) for v, (n, x) in (levels or {0: (1, 0.0)}).items()])
    need = F.when((F.col("threshold") > 0) & (F.col("length") > 0), F.col("threshold") / F.col("length") * (1 - SAFE))
    used = F.filter(known, lambda r: need.isNull() | (r["longest"] >= need))
    return queries.select("*", F.explode(used).alias("r")).select(*queries.columns, "r.level", "r.n")


def search(
    vectors: DataFrame,
    is_query,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    bucket: int = BUCKET,
    block: int = BLOCK,
    steep: float = STEEP,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best candidates.

    ``is_query`` is a condition on ``vec_id``; every row is a candidate for the queries other than itself.
    """
    rows = settled(integers(vectors, id_column, vector_column, scale), "vectors")
    n_levels = min(LEVELS, max(1, -(-rows.count() // bucket)))
    shares = [i / n_levels for i in range(1, n_levels)]
    edges = sorted({float(e) for e in rows.approxQuantile("norm2", shares, 0.2 / n_levels)}, reverse=True) if shares else []
    level = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("norm2") <= e)) if edges else F.lit(0)
    leveled = rows.withColumn("level", level)
    # At most LEVELS rows: how many buckets each range of lengths is dealt into, and its greatest length.
    ranges = leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("norm2")).alias("longest")).collect()
    parts = {r.level: -(-r.n // bucket) for r in ranges}
    dealt = [F.when(F.col("level") == v, F.pmod(F.xxhash64("vec_id"), F.lit(n))) for v, n in parts.items()]
    part = F.coalesce(*dealt, F.lit(0)).cast("int").alias("part")
    candidates = settled(leveled.select("vec_id", "x", "norm2", "level", part), "buckets")
    asked = rows.filter(is_query)
    n_blocks = max(1, -(-asked.count() // block))
    dealt_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    asked = asked.select(F.col("vec_id").alias("query_id"), "x", F.sqrt("norm2").alias("length"), dealt_block.alias("block"))
    longest = (F.col("level") == min(parts, default=0)) & (F.col("part") == 0)

    def met(queries: DataFrame, others) -> DataFrame:
        """Products of blocks of queries with the buckets that the condition ``others`` picks and a query can use."""
        left = reachable(queries, {r.level: (parts[r.level], r.longest) for r in ranges})
        left = settled(left.select("query_id", "x", "threshold", "block", "level", "n"), "reachable-levels")
        # Aliases, since both sides of the later join come from this frame.
        wanted = left.select(F.col("level").alias("level"), F.col("block").alias("block")).distinct()
        part = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part")
        left = left.select("query_id", "x", "threshold", "block", "level", part).filter(others)
        right = candidates.filter(others).join(wanted, "level").select("vec_id", "x", "norm2", "level", "part", "block")
        pair = ["block", "level", "part"]
        products = lambda a, b: bucket_products(a, b, k, steep)
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(products, HIT)

    seeds = settled(met(asked.withColumn("threshold", F.lit(float("-inf"))), longest), "seeds")
    least = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    least = least.filter(F.col("n") >= k).select("query_id", F.col("least").cast("double").alias("threshold"))
    seeded = asked.join(least, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    hits = seeds.unionByName(met(seeded, ~longest))
    limit = lambda n: F.lit(n).cast("decimal(38,0)")
    score = F.greatest(F.least("score", limit((1 << 63) - 1)), limit(-(1 << 63))).cast("bigint")
    return best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
