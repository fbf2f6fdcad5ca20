"""Importance resampling towards the word statistics of a target corpus.

Texts become counts of their words and word pairs in hashed buckets. A bucket's gain is the log
ratio of its shares in the target and in the corpus; a document's weight is the floored mean gain of
its features, read from one array. With a Gumbel number per document the highest scores are a
weighted draw without replacement, so drawing is sorting.

Ranks come from parallel sorting by regular sampling: every task sorts its run of scored rows and
marks rows at regular places in it; the marks of all runs give the splitters; rows are exchanged
into the segment between two splitters and sorted there; the counts of the segments before it give
each segment its first rank. Segments that begin after the last rank to draw are not exchanged.

Defined results: a null text is an empty one, which has no features and weight 0; a null id is
written as an empty one in the draw and comes last in ties; repeated rows are drawn separately; an
empty corpus gives an empty result, and an empty target smoothed shares of 1. Only the named columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tasks import settled, slices

# Lower-cases A-Z; what is not a letter, a digit or a byte above 127 becomes a space.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    """What is drawn. ``marks`` bounds the rows that the driver reads to choose splitters."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    marks: int = 100_000
    segment_rows: int = 250_000


def features(text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every word and of every two consecutive words) of a text."""
    words = text.translate(LETTERS).split()
    if not words:
        return 0, np.zeros(0, np.int64)
    single = list(map(crc32, words))
    # The checksum of a pair goes on from that of its first word.
    pairs = map(crc32, [b" " + w for w in words[1:]], single)
    return len(words), np.fromiter(chain(single, pairs), np.int64, 2 * len(words) - 1) % buckets


def raw(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text_column: str = "text", buckets: int = Settings.buckets) -> DataFrame:
    """(``bucket``, ``n``): features of all documents per bucket; each task hands on its sums."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for text in raw(batch):
                total += np.bincount(features(text, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = Settings.buckets) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket; the driver reads ``buckets`` counts of each."""

    def counted(frame):
        counts = np.zeros(buckets, np.int64)
        for bucket, n in frame.collect():
            counts[bucket] = n
        return counts

    ours, theirs = counted(corpus), counted(target)
    ours_all, theirs_all = int(ours.sum()) + buckets, int(theirs.sum()) + buckets
    ratios = [
        math.floor(1000 * math.log((t + 1.0) * ours_all / ((s + 1.0) * theirs_all)))
        for s, t in zip(ours.tolist(), theirs.tolist())
    ]
    return np.array(ratios, np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_features``, ``weight``) of every document."""
    buckets = len(gain)
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            found = []
            for text in raw(batch):
                words, used = features(text, buckets)
                found.append((words, len(used), int(sent.value[used].sum()) // max(1, len(used))))
            columns = np.array(found, np.int64).reshape(-1, 3)
            arrays = [batch.column("doc_id"), *[pa.array(columns[:, i]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def scored(weighted: DataFrame, seed: int = Settings.seed) -> DataFrame:
    """``weighted`` with ``score``: the weight and a Gumbel number drawn from the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise)


def order() -> list:
    """Highest scores first, ties to the smaller id; rows that are equal in both by their number."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]


def place(score, name, row) -> tuple:
    """The same order for rows in Python."""
    return -score, name is None, name, row


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def sorted_runs(rows: DataFrame, stride: int) -> DataFrame:
    """``rows`` sorted within each task; every ``stride``-th row of a run has a ``mark``."""

    def run(batches):
        at = stride // 2
        for batch in batches:
            marked = np.arange(at + 1, at + batch.num_rows + 1) % stride == 0
            at += batch.num_rows
            yield batch.append_column("mark", pa.array(marked))

    return rows.sortWithinPartitions(*order()).mapInArrow(run, f"{schema_of(rows)}, mark boolean")


def cut(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``segment``: the number of splitters that do not come after a row."""

    def run(batches):
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("score", "doc_id", "row")])
            found = pa.array([bisect_right(splitters, place(*k)) for k in keys], pa.int32())
            yield batch.append_column("segment", found)

    return runs.mapInArrow(run, f"{schema_of(runs)}, segment int")


def exact_ranks(rows: DataFrame, draw: int, settings: Settings = Settings()) -> DataFrame:
    """``rank`` (from 1, by descending ``score``, ties to the smaller ``doc_id``) up to ``draw``, else null."""
    columns = rows.columns
    stored = settled(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    total = stored.count()
    runs = settled(sorted_runs(stored, max(1, total // settings.marks)), "sorted-runs")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    segments = min(max(-(-total // settings.segment_rows), min(cores, total // 1000), 1), settings.marks // 4)
    # About ``marks`` rows, however many there are in all.
    marks = sorted(place(*m) for m in runs.filter("mark").select("score", "doc_id", "row").collect())
    splitters = sorted({marks[len(marks) * i // segments] for i in range(1, segments)}) if marks else []
    placed = cut(runs, splitters)
    sizes = dict(placed.groupBy("segment").count().collect())
    ends = list(accumulate(sizes.get(s, 0) for s in range(len(splitters) + 1)))
    before = [0, *ends]
    reached = bisect_left(ends, draw) + 1 if draw else 0  # segments that hold a rank to draw

    def number(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = before[batch.column("segment")[0].as_py()]
            ranks = np.arange(at + 1, at + batch.num_rows + 1)
            at += batch.num_rows
            found = pa.array(ranks, pa.int64(), mask=ranks > draw)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], found], [*columns, "rank"])

    exchanged = placed.filter(F.col("segment") < reached).repartitionById(max(1, reached), F.col("segment"))
    ranked = exchanged.sortWithinPartitions(*order()).mapInArrow(number, f"{schema_of(rows)}, rank bigint")
    undrawn = placed.filter(F.col("segment") >= reached)
    return ranked.unionByName(undrawn.select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text_column: str = "text",
) -> DataFrame:
    """(``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``) of every document.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred are drawn; ``rank``
    is null for all others.
    """
    gain = gains(
        bucket_counts(docs, text_column, settings.buckets),
        bucket_counts(target, target_text_column, settings.buckets),
        settings.buckets,
    )
    found = settled(scored(weights(docs, gain, id_column, text_column), settings.seed), "weights")
    able = found.filter(F.col("n_words") >= settings.least_words).drop("n_words")
    ranked = exact_ranks(able, able.count() * settings.percent // 100, settings)
    short = found.filter(F.col("n_words") < settings.least_words).drop("n_words")
    return ranked.unionByName(short.withColumn("rank", F.lit(None).cast("bigint")))
