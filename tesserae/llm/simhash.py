"""SimHash near-duplicates with multi-index hashing.

A fingerprint has one bit per position of the 64-bit shingle hashes: set if more than half of
them have it. Distinct fingerprints at ``max_bits`` or fewer differing bits are linked, and the
connected groups are the near-duplicate classes. For the search a fingerprint is cut into
segments so short that of two linked ones at least one segment differs in at most ``radius``
bits. Every fingerprint is filed under its segment values, probes the values in the small
Hamming ball around its own, and whole distances are verified.

Copies collapse before the search: it runs over distinct fingerprints. Segment values with more
than ``hot_bucket`` fingerprints are linked through shared ball points instead of pairs, which
takes rows in proportion to the fingerprints and connects exactly the same groups. Probes and ball
points are some dozens of rows per fingerprint; they are joined by merging, never sent whole.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link
like all others; repeated rows return repeatedly; a null id is kept, and a class in which every id
is null has a null class id; an empty table gives an empty result. Only the two named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import connect
from tesserae.llm.tasks import slices
from tesserae.workspace import store

BITS = 64
HASH_SEED = 42
SHINGLE = 3
MAX_BITS = 3
HOT_BUCKET = 64
CHUNK = 1 << 14


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer, per row of ``docs``."""

    def run(batches):
        digest = xxhash.xxh64_intdigest

        def fingerprint(text) -> int:
            # Lower-cases A-Z only, and splits at exactly the bytes 9-13 and 32.
            words = text.lower().split() if text else ()
            if not words:
                return 0
            whole = b" ".join(words)
            if len(words) < shingle:
                hashes = np.array([digest(whole, HASH_SEED)], np.uint64)
            else:
                starts = [0]
                for word in words:
                    starts.append(starts[-1] + len(word) + 1)
                stops = starts[shingle:]
                hashes = np.array([digest(whole[a : b - 1], HASH_SEED) for a, b in zip(starts, stops)], np.uint64)
            counts = np.zeros(BITS, np.int64)
            for at in range(0, len(hashes), CHUNK):
                part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            packed = np.packbits(counts * 2 > len(hashes), bitorder="little")
            return int(packed.view(np.int64)[0])

        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            found = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def masks(width: int, radius: int) -> list[int]:
    """Every ``width``-bit number with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def segment(fp, number: int, segments: int):
    """The value of one of the ``segments`` nearly equal parts of a fingerprint."""
    low, high = number * BITS // segments, (number + 1) * BITS // segments
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (``a``, ``b``) that connect the distinct fingerprints ``fp`` of ``nodes`` like all near pairs do.

    Both ends of a pair differ in at most ``max_bits`` bits, every two such fingerprints are
    connected, and segment values without more than ``hot_bucket`` fingerprints give all their pairs.
    Of a pair only the end that lacks the top bit of the difference probes, so it is found once a segment.
    """
    radius = max_bits // segments
    width = -(-BITS // segments)
    fp = F.col("fp")
    filed = F.array(*[F.struct(F.lit(s).alias("s"), segment(fp, s, segments).alias("v")) for s in range(segments)])
    table = nodes.select("fp", F.explode(filed).alias("k")).select("fp", "k.s", "k.v")
    sizes = table.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
    hot = store(sizes.filter(F.col("n") > hot_bucket).select("s", "v"), "hot-segments")
    ball = F.array(*[F.lit(m).cast("bigint") for m in masks(width, radius)])
    near = F.filter(ball, lambda m: (m == 0) | (m.bitwiseAND(F.col("v")) < m.bitwiseXOR(F.col("v")).bitwiseAND(m)))
    probes = table.select("fp", "s", "v", F.explode(near).alias("m")).select(
        "fp", "s", F.col("v").bitwiseXOR(F.col("m")).alias("v"), F.bit_count("m").alias("e")
    )
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    cool = table.join(hot, ["s", "v"], "left_anti").withColumnRenamed("fp", "b")
    # Spark sizes exploded rows as the table below the explode and would send them whole, so they are merged.
    pairs = (
        probes.withColumnRenamed("fp", "a")
        .join(cool.hint("merge"), ["s", "v"])
        .filter((apart <= max_bits) & ((F.col("e") > 0) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )
    return pairs.unionByName(through_points(probes, table, hot, max_bits, segments, radius))


def through_points(probes, table, hot, max_bits: int, segments: int, radius: int) -> DataFrame:
    """Links into hot segment values without forming pairs.

    A probe that is ``e`` bits away from a hot value is linked with a member if the rest of their
    bits differ in at most ``max_bits - e``. Two numbers that far apart share a point within
    ``half`` bits of the member and within the remaining bits of the probe, and every member and
    probe at a point are that close. So at each point all of them are linked with one member.
    """
    half = (max_bits - 1) // 2

    def points(rows: DataFrame, reach: int) -> DataFrame:
        """The other bits of each fingerprint, and every number up to ``reach`` bits away from them."""
        parts = []
        for s in range(segments):
            low, high = s * BITS // segments, (s + 1) * BITS // segments
            outside = [b for b in range(BITS) if not low <= b < high]
            flips = [[signed(sum(1 << b for b in bits)) for bits in combinations(outside, n)] for n in range(reach + 1)]
            ball = F.array(*[F.lit(m).cast("bigint") for group in flips for m in group])
            others = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in outside))).cast("bigint"))
            part = rows.filter(F.col("s") == s).select("fp", "s", "v", others.alias("r"), F.explode(ball).alias("m"))
            parts.append(part.select("fp", "s", "v", F.col("r").bitwiseXOR(F.col("m")).alias("z")))
        return reduce(DataFrame.unionByName, parts)

    members = points(table.join(hot, ["s", "v"], "left_semi"), half)
    anchors = members.groupBy("s", "v", "z").agg(F.min("fp").alias("b"))
    into_hot = probes.join(hot, ["s", "v"], "left_semi")
    reached = members
    for e in range(radius + 1):
        reached = reached.unionByName(points(into_hot.filter(F.col("e") == e).drop("e"), max_bits - half - e))
    found = reached.join(anchors.hint("merge"), ["s", "v", "z"]).filter(F.col("fp") != F.col("b"))
    return found.select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    segments: int = 2,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """``doc_id``, ``fp``, ``fingerprint`` (16 hex digits) and ``component_id`` per row of ``docs``.

    ``component_id`` is the smallest id among all rows reachable over links, the row included.
    """
    marked = store(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    edges = store(links(nodes.select("fp"), max_bits, segments, hot_bucket), "fingerprint-links")
    groups = connect(edges)  # node, root; only nodes that have a link
    grouped = groups.join(nodes, groups.node == nodes.fp).select("node", "root", "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("component"))
    moved = grouped.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    named = store(named, "fingerprint-classes")  # both sides of the last join are plain scans, whose hot keys Spark splits
    return marked.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
