"""Removal of word passages that repeat across documents, found through difference-cover anchors.

Words at positions whose remainder modulo ``period`` lies in a difference cover start an anchor of
``width - period + 1`` words. Any two equal windows of ``width`` words, whatever their places, hold
a pair of equal anchors at the same distance from their starts, since every difference of places
is a difference of two cover members. So windows that contain no anchor shared by two documents
are unique, and only the others are extended to whole windows, compared by 128-bit keys. Anchors
are a filter: a chance agreement of their 64-bit keys costs time, never words.

Exact copies of a word sequence are settled by their whole keys. Each step works on combined
aggregates and equi-joins, so a passage that a third of all documents share is never in one task.

Defined results: ids are integers, and others raise a ``ValueError``; a null text is an empty one; a null id counts as larger than all others; repeated
rows (same id and text) have equal results and do not remove from each other; other rows with the
same id neither; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.llm.tasks import settled, slices
from tesserae.llm.words import Words, powers, window_starts, windows

WIDTH = 50
PERIOD = 31
LAST = (1 << 63) - 1

# Perfect difference sets by modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ROW = "d bigint, k bigint"


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows as (``doc_id``, ``d``, ``k``, ``text``): the id as a number without nulls, and a key of the text."""
    if not isinstance(docs.schema[id_column].dataType, IntegralType):
        raise ValueError(f"ids must be integers, whose order decides what stays: {id_column}")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(LAST)).alias("d"),
        F.xxhash64(text).alias("k"),
        text.alias("text"),
    )


def heads(rows: DataFrame) -> DataFrame:
    """Per row its words' count, the 128-bit key of their sequence and the digest of the joined words."""

    def run(batches):

        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            places = np.arange(len(words.starts)) - np.repeat(words.first[:-1], words.counts)
            wholes = []
            for kind in (0, 1):
                up, _ = powers(kind, int(words.counts.max(initial=0)))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(words.keys(kind) * up[places], dtype=np.uint64)])
                wholes.append((sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64))
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "d", "k")),
                    *(pa.array(x, pa.int64()) for x in (words.counts, *wholes)),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "d", "k", "n_words", "w0", "w1", "whole_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, {ROW}, n_words bigint, w0 bigint, w1 bigint, whole_sha256 string"
    )


def anchors(rows: DataFrame, width: int, period: int) -> DataFrame:
    """(``h``, ``d``, ``k``, ``at``): key and place of every anchor of texts with a whole window."""
    cover, short = COVERS[period], width - period + 1

    def run(batches):
        table = np.isin(np.arange(period), cover)
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            starts = window_starts(words.first, short)
            owner = np.repeat(np.arange(words.n_texts), np.maximum(words.counts - short + 1, 0))
            places = starts - words.first[owner]
            used = table[places % period] & (words.counts[owner] >= width)
            owner, places = owner[used], places[used]
            found = windows(words.keys(), short, 0, starts[used])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.view(np.int64)),
                    *(pa.array(batch.column(c).to_numpy(zero_copy_only=False)[owner], pa.int64()) for c in ("d", "k")),
                    pa.array(places.astype(np.int32)),
                ],
                ["h", "d", "k", "at"],
            )

    return rows.select("d", "k", "text").mapInArrow(run, f"h bigint, {ROW}, at int")


def extended(held: DataFrame, width: int, period: int) -> DataFrame:
    """(``h0``, ``h1``, ``d``, ``k``, ``at``): every whole window that holds one of the anchors ``places``."""
    short = width - period + 1

    def run(batches):
        for batch in slices(batches, "text", 1 << 19):
            words = Words(batch.column("text"))
            keys = [words.keys(0), words.keys(1)]
            parts = []
            for i, places in enumerate(batch.column("places").to_pylist()):
                n = int(words.counts[i])
                marks = np.zeros(n + 1, np.int64)
                at = np.asarray(places, np.int64)
                np.add.at(marks, np.maximum(at - (width - short), 0), 1)
                np.add.at(marks, at + 1, -1)
                inside = np.flatnonzero(np.cumsum(marks)[:n] > 0)
                parts.append(inside[inside <= n - width] + words.first[i])
            starts = np.concatenate([np.zeros(0, np.int64), *parts])
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(windows(keys[kind], width, kind, starts).view(np.int64)) for kind in (0, 1)),
                    *(pa.array(batch.column(c).to_numpy(zero_copy_only=False)[owner], pa.int64()) for c in ("d", "k")),
                    pa.array((starts - words.first[owner]).astype(np.int32)),
                ],
                ["h0", "h1", "d", "k", "at"],
            )

    return held.mapInArrow(run, f"h0 bigint, h1 bigint, {ROW}, at int")


def without(held: DataFrame, width: int) -> DataFrame:
    """(``d``, ``k``, ``kept``, ``n_removed``): texts without the words of the windows at ``removed``."""

    def run(batches):
        for batch in slices(batches, "text"):
            kept, gone = [], []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for text, places in zip(texts, batch.column("removed").to_pylist()):
                words = text.split()
                marks = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(places, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + width, -1)
                left = np.flatnonzero(np.cumsum(marks)[:-1] == 0)
                kept.append(b" ".join([words[i] for i in left]).decode())
                gone.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("k"), pa.array(kept, pa.string()), pa.array(gone, pa.int64())],
                ["d", "k", "kept", "n_removed"],
            )

    return held.mapInArrow(run, f"{ROW}, kept string, n_removed bigint")


class Repeats:
    """The repeated passages of a document table: ``heads`` of all rows, ``copies`` and ``changed`` texts."""

    def __init__(
        self,
        docs: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        width: int = WIDTH,
        period: int = PERIOD,
    ):
        self.rows = keyed(docs, id_column, text_column)
        rows, same = self.rows, ["n_words", "w0", "w1"]
        self.heads = settled(heads(rows), "repeat-heads")
        whole = self.heads.filter(F.col("n_words") >= width)
        owners = whole.groupBy(*same).agg(F.min("d").alias("owner"), F.max("d").alias("last"))
        # Stored, so that the join below is one of two plain scans, whose hot keys Spark splits.
        owners = settled(owners.filter("owner < last").select(*same, "owner"), "repeat-owners")
        copies = whole.join(owners, same).filter(F.col("d") > F.col("owner"))
        self.copies = settled(copies.select("d", "k", "n_words").distinct(), "repeat-copies")

        found = anchors(rows, width, period)
        spread = found.select("h", "d").groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        shared = settled(spread.filter("lo < hi").select("h"), "repeat-anchors")
        places = found.join(shared, "h", "left_semi").groupBy("d", "k").agg(F.collect_set("at").alias("places"))
        places = settled(places.join(self.copies, ["d", "k"], "left_anti"), "repeat-places")
        held = rows.select("d", "k", "text").join(places, ["d", "k"])
        held = settled(held, "repeat-held")

        grown = extended(held, width, period)
        firsts = grown.groupBy("h0", "h1").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        firsts = settled(firsts.filter("lo < hi").select("h0", "h1", "lo"), "repeat-windows")
        later = grown.join(firsts, ["h0", "h1"]).filter(F.col("d") > F.col("lo"))
        later = settled(later.groupBy("d", "k").agg(F.collect_set("at").alias("removed")), "repeat-removed")
        changed = without(held.select("d", "k", "text").join(later, ["d", "k"]), width)
        self.changed = settled(changed.dropDuplicates(["d", "k"]), "repeat-changed")

    def judged(self) -> DataFrame:
        """All rows: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words, joined by a space."""
        copy = self.copies.select("d", "k", F.lit(True).alias("copy"))
        cut = self.changed.select("d", "k", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
        rows = self.heads.join(copy, ["d", "k"], "left").join(cut, ["d", "k"], "left")
        removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
        digest = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "whole_sha256"))
        return rows.select("doc_id", "n_words", removed.alias("n_removed"), digest.alias("kept_sha256"))

    def rewritten(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """``docs`` with all columns; texts that lose words become their kept words, joined by a space."""
        emptied = self.copies.select("d", "k", F.lit("").alias("kept"))
        news = self.changed.select("d", "k", "kept").unionByName(emptied)
        text = F.col(f"rows.`{text_column}`").cast("string")
        rows = docs.alias("rows").join(
            news.alias("news"),
            (F.coalesce(F.col(f"rows.`{id_column}`").cast("bigint"), F.lit(LAST)) == F.col("news.d"))
            & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("news.k")),
            "left",
        )
        changed = F.coalesce(F.col("news.kept"), F.col(f"rows.`{text_column}`")).alias(text_column)
        return rows.select(*[changed if c == text_column else F.col(f"rows.`{c}`") for c in docs.columns])
