"""Hierarchical residual packing of token pieces into sequences of bounded length.

Documents become ids and an end id; longer ones are cut into full pieces from their end, so the
first piece may be shorter. Packing runs in the same rounds at every size. In each round every group
takes a bounded number of items, best-fits them and emits the bins that are full up to a slack; the
underfull bins go on as items of the next round, in fewer groups, with a larger slack. The last round
best-fits what is left without a slack. A group never holds more than ``group_items`` items, a small
table is cut into ``FIRST_GROUPS`` of them all the same, and items carry only their size.

Defined results: a null text is an empty one, which gives one piece of the end id alone; repeated
rows are packed separately; null ids are kept; an empty table gives an empty result. ``pieces`` reads
only the two named columns; ``pack`` keeps all columns, whatever their names, but ``sequence_id`` and
``offset``, which it replaces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tasks import cached, free, settled, slices, strings
from tesserae.llm.vocabulary import ByteVocabulary

CAPACITY = 1024
END_ID = 2
GROUP_ITEMS = 200_000
FIRST_GROUPS = 8
SLACKS = (4, 32)


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``), and ``ids`` if asked, of every document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    with open(tokenizer_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    end = end_id.to_bytes(4, "little")

    def run(batches):
        vocabulary = cached(("byte vocabulary", tokenizer_file), lambda: ByteVocabulary(content.value))
        for batch in slices(batches, "text"):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(strings(batch.column("text"))):
                whole = vocabulary.encode(text) + end
                total = len(whole) // 4
                at, n, number = 0, total % capacity or capacity, 0
                while at < total:
                    part = whole[4 * at : 4 * (at + n)]
                    owner.append(i)
                    piece.append(number)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
                    at, n, number = at + n, capacity, number + 1
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                offsets = np.concatenate([[0], np.cumsum(np.array(length, np.int64))]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int, slack: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items in descending size: (bin, offset) per item and the fill per bin.

    With a slack, an item joins a bin only if it leaves at most that much room; otherwise it joins
    the fullest bin that has room for it. Bins with equal room are taken last in, first out.
    """
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = open_rooms >> size
        spare = (fitting & -fitting).bit_length() - 1 if fitting else -1
        if spare < 0 or slack is not None and spare > slack:
            bins[item], offsets[item] = len(fills), 0
            fills.append(size)
            left = capacity - size
            own = len(fills) - 1
        else:
            own = room[size + spare].pop()
            if not room[size + spare]:
                open_rooms ^= 1 << (size + spare)
            bins[item], offsets[item] = own, fills[own]
            fills[own] += size
            left = spare
        if left:
            room[left].append(own)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def packed(items: DataFrame, size: str, capacity: int, slack: int | None, number: int, group_items: int, names) -> DataFrame:
    """``items`` with the columns ``names``: bin, offset in it and the bin's fill, packed within each task."""

    def run(batches):
        part, group = TaskContext.get().partitionId(), 0
        waiting, rows = [], 0

        def out():
            nonlocal group
            table = pa.Table.from_batches(waiting).combine_chunks()
            bins, offsets, fills = best_fit(table.column(size).to_numpy(), capacity, slack)
            ids = bins + ((number << 60) + (part << 34) + (group << 20))
            group += 1
            for name, values in zip(names, (ids, offsets, fills[bins])):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.to_batches()

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, group_items - rows)
                batch = batch.slice(taken.num_rows)
                waiting.append(taken)
                rows += taken.num_rows
                if rows == group_items:
                    yield from out()
                    waiting, rows = [], 0
        if rows:
            yield from out()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(run, fields + "".join(f", `{name}` bigint" for name in names))


def pack(
    items: DataFrame,
    size: str = "length",
    capacity: int = CAPACITY,
    slacks: tuple[int, ...] = SLACKS,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity``."""
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    stored = settled(items.select(*columns), "pack-items")
    bin_, shift, fill, next_, more = (free(n, columns) for n in ("_bin", "_shift", "_fill", "_next", "_more"))
    full = F.col(size) >= capacity

    def dealt(rows: DataFrame, groups: int) -> tuple[DataFrame, int]:
        """Rows in tasks of about ``group_items``, no shuffle, and the items of a group: ``groups`` of them or more."""
        n = rows.count()
        return rows.coalesce(max(1, -(-n // group_items))), min(group_items, max(1, -(-n // groups)))

    loose, most = dealt(stored.filter(~full), FIRST_GROUPS)
    placed = settled(packed(loose, size, capacity, slacks[0], 0, most, (bin_, shift, fill)), "pack-round")
    result = placed
    for number, slack in enumerate((*slacks[1:], None), 1):
        open_bins = placed.filter(F.col(fill) < capacity - slacks[number - 1]).select(F.col(bin_).alias("item"), F.col(fill).alias("room"))
        # Half as many groups a round, and one in the last, as long as they do not outgrow a task.
        groups = FIRST_GROUPS >> number if slack is not None else 1
        under, most = dealt(settled(open_bins.distinct(), "pack-underfull"), max(1, groups))
        placed = settled(packed(under, "room", capacity, slack, number, most, (bin_, shift, fill)), "pack-round")
        moved = placed.select(F.col("item").alias(bin_), F.col(bin_).alias(next_), F.col(shift).alias(more))
        result = result.join(moved, bin_, "left").select(
            *columns,
            F.coalesce(next_, bin_).alias(bin_),
            (F.col(shift) + F.coalesce(more, F.lit(0))).alias(shift),
        )
    alone = stored.filter(full).select(
        *columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return result.select(*columns, F.col(bin_).alias("sequence_id"), F.col(shift).alias("offset")).unionByName(alone)
