"""Helpers of code that runs inside tasks: per-worker caches and bounded slices of Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def cached(key, make: Callable):
    """``make()``, once per worker process and key; workers serve many tasks."""
    store = sys.modules.setdefault("_tesserae_worker_cache", types.ModuleType("_tesserae_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batches`` with at most ``limit`` bytes in ``column``, or a single row.

    Work arrays are several times as large as the text they describe, so they are made for a
    slice, not for a whole batch; whole texts are always kept together.
    """
    for batch in batches:
        values = batch.column(column)
        offsets = text_offsets(values)
        start = 0
        while start < batch.num_rows:
            stop = int(offsets.searchsorted(offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(values: pa.Array):
    """Byte offsets of the texts of a string or binary array, one more than its rows."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    if not len(values):
        return np.zeros(1, np.int64)
    raw = np.frombuffer(values.buffers()[1], kind, len(values) + 1, values.offset * np.dtype(kind).itemsize)
    return raw.astype(np.int64)


def text_bytes(values: pa.Array):
    """(bytes, offsets) of a string or binary array as numpy arrays without a copy; nulls are empty."""

    offsets = text_offsets(values)
    buffer = values.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(values: pa.Array) -> list[str]:
    """The texts of a column as a list; nulls are empty."""
    return ["" if v is None else v for v in values.to_pylist()]


def filled(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column without nulls: they become empty texts."""
    values = batch.column(column)
    return pc.fill_null(values, "") if values.null_count else values


def kept_rows(docs, column: str, mask: Callable[[pa.RecordBatch], list]):
    """The rows of ``docs``, with all their columns, for which ``mask`` of a slice of them is true; no shuffle."""

    def run(batches):
        for batch in slices(batches, column):
            yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def free(name: str, taken) -> str:
    """``name``, with as many underscores in front as it takes to differ from the columns ``taken``."""
    while name in taken:
        name = f"_{name}"
    return name


def digest(*key: str):
    """The low 40 bits of a digest of ``key``."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(*key), F.lit(1 << 40))


def below(rows, n: int, total: int, *key: str):
    """Of ``total`` rows those whose digest of ``key`` is not far above the n-th smallest.

    What tasks hand on for a final choice then has the size of the sample, however many tasks there
    are. Digests are uniform, so with four times the share needed a shortfall is next to impossible.
    """
    return rows.filter(digest(*key) < int((1 << 40) * 4 * n / total)) if total > 4 * n else rows


def picked(rows, n: int, total: int, *key: str):
    """``n`` of ``total`` rows by the smallest digests of ``key``, or all if there are fewer."""
    return below(rows, n, total, *key).orderBy(digest(*key), *key).limit(n)


def settled(df, label: str):
    """``workspace.store`` that also removes the shuffle files of the write as soon as it is complete.

    The frame is not run again, so nothing is lost with them, and a chain of steps holds the
    shuffle files of one step at a time.
    """
    from tesserae.workspace import store

    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return store(df, label)
    finally:
        conf.set(key, before)
