"""Prefix trie of conversations, built from whole sequences.

A conversation is a sequence of turns (role, text). Turns become digests; the key of a prefix is the
exclusive or of the 128-bit hashes of its turns at their places, so keys need neither an order of
work nor a whole conversation in one task. Then

1. identical conversations collapse into one weighted sequence with the list of its ids;
2. sequences that are proper prefixes of others are dropped by an anti join: the rest are the leaves;
3. the prefixes of the sequences are aggregated, with their weights, to the nodes.

Sums over subtrees come from the same aggregation. Every sequence knows what follows each of its
prefixes; a sequence's share of a subtree is what it passes through first (of the sequences through
a node, that with the smallest id has it), which is a run of places up to its end. So no node is
paired with its ancestors, and the work grows with the turns.

Defined results: ids are whole numbers; a null role or text is an empty one; turns are in the order of ``turn``, nulls
first, equal ones by role, then by the first 64 characters and the digest of the text, and repeated
rows are repeated turns; rows with a null id take no part; an empty table gives an empty result. Only the named columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.tasks import settled
from tesserae.operators.ranking import positions
from tesserae.workspace import store

FAMILY = 100
CUTS = 6
HEAD = 64
BLOCK = 4096
END_LIST = 1024
NODE = ["d", "x", "y"]


def turns(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Stored (``conv_id``, ``pos``, ``role``, ``digest``, ``n``): the turns, numbered from 1, and their code points."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        F.md5(text).alias("digest"),
        F.length(text).cast("bigint").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = positions(settled(rows, "turns"), ["conv_id"], ["turn", "role", "head", "digest", "row"])
    return settled(placed.select("conv_id", "pos", "role", "digest", "n"), "placed-turns")


def placed(rows: DataFrame) -> DataFrame:
    """``x`` and ``y``, two hashes of a turn at place ``d``, instead of its role and digest."""
    return rows.select(
        "conv_id",
        "d",
        F.xxhash64("d", "role", "digest").alias("x"),
        F.xxhash64(F.lit("second"), "d", "role", "digest").alias("y"),
        "n",
    )


def starts(convs: DataFrame) -> DataFrame:
    """A row at place 0 for each conversation, which stands for the empty prefix."""
    zero = F.lit(0).cast("bigint")
    return convs.select("conv_id", zero.alias("d"), zero.alias("x"), zero.alias("y"), zero.alias("n"))


def sequences(numbered: DataFrame) -> DataFrame:
    """Turns as ``turns`` returns them in the form that ``trie`` takes."""
    convs = numbered.select("conv_id").distinct()
    return placed(numbered.withColumnRenamed("pos", "d")).unionByName(starts(convs))


def rebuilt(numbered: DataFrame, family: int = FAMILY, cuts: int = CUTS) -> DataFrame:
    """Sequences that share their beginning with the first conversation of their family of ids.

    Conversation c is given the first h turns of conversation c - c % ``family`` (fewer if that is
    shorter, none if it is absent), then its own turns after its first h; h is the CRC-32 of the
    decimal c modulo ``cuts``. Only ``cuts`` - 1 turns of a first conversation are ever joined, with
    the at most ``family`` ids of its family.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cuts).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    convs = store(numbered.select("conv_id").distinct().select("conv_id", h, base), "conversations")
    first = numbered.filter((F.col("conv_id") % family == 0) & (F.col("pos") < cuts))
    first = store(first.select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "role", "digest", "n"), "heads")
    taken = convs.filter("h > 0").join(first, "base").filter("d <= h").select("conv_id", "d", "role", "digest", "n")
    # Where the first conversation has fewer than h turns, own turns move forward.
    sizes = first.groupBy("base").agg(F.max("d").alias("size"))
    short = convs.filter("h > 0").join(sizes, "base", "left")
    short = short.select("conv_id", (F.col("h") - F.coalesce("size", F.lit(0))).alias("lack")).filter("lack > 0")
    own = numbered.withColumn("h", h).filter("pos > h").join(store(short, "short-heads"), "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("d"), "role", "digest", "n")
    return placed(taken.unionByName(own)).unionByName(starts(convs))


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``x`` and ``y`` become the keys of the prefix that ends at a row; ``before`` is the text before that row.

    ``px`` and ``py`` are the keys of the prefix that is one turn shorter. Long conversations are
    cut into blocks of places; what a block begins with is carried over from the blocks before it.
    """
    cut = rows.withColumn("b", F.floor(F.col("d") / block))
    blocks = cut.groupBy("conv_id", "b").agg(
        F.bit_xor("x").alias("cx"), F.bit_xor("y").alias("cy"), F.sum("n").alias("cn")
    )
    earlier = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    over = lambda f, c: f(c).over(earlier).alias(c)
    carried = blocks.select("conv_id", "b", over(F.bit_xor, "cx"), over(F.bit_xor, "cy"), over(F.sum, "cn"))
    carried = store(carried.filter("b > 0"), "prefix-blocks")
    inside = W.partitionBy("conv_id", "b").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = cut.withColumns(
        {"rx": F.bit_xor("x").over(inside), "ry": F.bit_xor("y").over(inside), "rn": F.sum("n").over(inside)}
    ).join(carried, ["conv_id", "b"], "left")
    zero = F.lit(0).cast("bigint")
    kx = F.col("rx").bitwiseXOR(F.coalesce("cx", zero))
    ky = F.col("ry").bitwiseXOR(F.coalesce("cy", zero))
    return run.select(
        *[c for c in rows.columns if c not in ("x", "y", "n")],
        kx.alias("x"),
        ky.alias("y"),
        kx.bitwiseXOR(F.col("x")).alias("px"),
        ky.bitwiseXOR(F.col("y")).alias("py"),
        (F.col("rn") + F.coalesce("cn", zero) - F.col("n")).alias("before"),
    )


def end_digests(whole: DataFrame, size: int = END_LIST) -> DataFrame:
    """(``d``, ``x``, ``y``, ``ends_sha256``): SHA-256 of the ids of each sequence, ascending, joined by commas.

    Ids are joined in lists of at most ``size``, by ranges of ids. The digest of one sequence is by
    its nature one after another, so its lists pass through one task, but in a stream.
    """
    lists = whole.groupBy(*NODE, F.floor(F.col("conv_id") / size).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = lists.repartition(*NODE).sortWithinPartitions(*NODE, "part")

    def run(batches):
        current, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
            for *key, ids in zip(*columns):
                if key != current:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digests(done)
        if current is not None:
            yield digests([(*current, state.hexdigest())])

    def digests(done):
        columns = list(zip(*done)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, [*NODE, "ends_sha256"])

    return ordered.mapInArrow(run, "d bigint, x bigint, y bigint, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of the sequences ``rows`` (``conv_id``, ``d``, ``x``, ``y``, ``n``).

    Per node: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``; ``n_convs``;
    ``n_children``; ``n_leaves`` of its subtree; ``saved_tokens``, the code points that its subtree
    saves by storing each node once; ``ends_sha256`` of the conversations that end there.
    """
    rows = settled(rows, "sequences")
    whole = rows.groupBy("conv_id").agg(
        F.max("d").alias("d"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("total")
    )
    whole = settled(whole, "whole-sequences")
    collapsed = whole.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("total")
    )
    collapsed = settled(collapsed, "weighted-sequences")
    one = collapsed.select("conv_id", F.col("d").alias("length"), "weight", "total")
    paths = settled(prefixes(rows.join(one, "conv_id")), "prefixes")

    inner = paths.filter("d < length").select(*NODE).distinct()
    leaves = collapsed.join(inner, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    rest = F.col("total") - F.col("before")
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.col("weight") * rest).alias("held"),
        F.min("before").alias("before"),
        F.min("px").alias("px"),
        F.min("py").alias("py"),
    )
    nodes = settled(nodes, "nodes")
    own = nodes.groupBy("conv_id").agg(F.min("before").alias("own"))
    marks = collapsed.select("conv_id").join(leaves, "conv_id", "left").join(own, "conv_id", "left")
    share = F.col("total") - F.greatest("before", F.coalesce("own", "total"))
    zero = F.lit(0).cast("bigint")
    passed = paths.join(settled(marks, "leaves"), "conv_id").select(
        *NODE, share.alias("once"), F.coalesce("leaf", F.lit(0)).cast("bigint").alias("leaf"), zero.alias("child")
    )
    children = nodes.filter("d > 0").select(
        (F.col("d") - 1).alias("d"),
        F.col("px").alias("x"),
        F.col("py").alias("y"),
        zero.alias("once"),
        zero.alias("leaf"),
        F.lit(1).cast("bigint").alias("child"),
    )
    sums = passed.unionByName(children).groupBy(*NODE)
    sums = sums.agg(F.sum("once").alias("once"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

    # Both sides are plain scans, so that Spark can split a parent with many children.
    parents = nodes.select(
        (F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent")
    )
    named = settled(nodes.join(store(parents, "parents"), ["d", "px", "py"], "left"), "named-nodes")
    none = hashlib.sha256(b"").hexdigest()
    return (
        named.join(sums, NODE)
        .join(end_digests(whole), NODE, "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            F.when(F.col("d") > 0, F.col("parent")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("held") - F.col("once")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
