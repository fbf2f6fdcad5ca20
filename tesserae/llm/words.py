"""Words of Arrow text columns as numpy arrays: places, 64-bit keys and keys of word windows.

A word is a longest run of bytes other than space and the control characters 9 to 13, which is
the pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Keys are polynomial hashes modulo 2**64 with a random
table per ``kind``, computed with running sums, so no Python code runs per word. Two kinds
together give 128 bits where equal keys must mean equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tesserae.llm.tasks import cached, text_bytes

BLOCK = 1 << 20
MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Words:
    """The words of the texts of one column: byte ``starts`` and ``ends``, and ``first`` word of each text."""

    def __init__(self, values: pa.Array):
        self.data, self.offsets = text_bytes(values)
        self.n_texts = len(values)
        solid = ~cached("word breaks", breaks)[self.data]
        left = np.empty(len(solid), bool)
        left[1:] = ~solid[:-1]
        inner = self.offsets[:-1][self.offsets[:-1] < len(solid)]
        left[inner] = True
        if len(solid):
            left[0] = True
        self.starts = np.flatnonzero(solid & left)
        right = np.empty(len(solid), bool)
        right[:-1] = left[1:] | ~solid[1:]
        if len(solid):
            right[-1] = True
        self.ends = np.flatnonzero(solid & right) + 1
        self.solid = solid
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def texts_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def keys(self, kind: int = 0) -> np.ndarray:
        """A 64-bit key per word, equal for equal words."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK, side="right")))
            low, high = int(self.starts[at]), int(self.ends[stop - 1])
            up, down = powers(kind, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(cached(("letters", kind), lambda: letters(kind))[self.data[low:high]] * up[: high - low], out=sums[1:])
            starts = self.starts[at:stop] - low
            out[at:stop] = (sums[self.ends[at:stop] - low] - sums[starts]) * down[starts]
            at = stop
        return mixed(out)


def breaks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def letters(kind: int) -> np.ndarray:
    return np.random.default_rng(1000 + kind).integers(1, MASK, 256, dtype=np.uint64)


def powers(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2**64, raised to 0 .. n - 1 or further."""

    def make(size):
        tables = []
        for base in (BASES[kind], pow(BASES[kind], -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        return tables

    size = max(BLOCK + 1, 1 << int(n).bit_length())
    return cached(("powers", kind, size), lambda: make(size))


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads the bits of keys (the finalizer of a public mixing function), so that low bits can be used alone."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def windows(keys: np.ndarray, width: int, kind: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A key per window of ``width`` words that starts at word ``at`` (all by default).

    Windows that run over the end of a text must be left out by the caller.
    """
    n = len(keys)
    at = np.arange(max(0, n - width + 1)) if at is None else at
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(at), BLOCK // 4):
        own = at[low : low + BLOCK // 4]
        if not len(own):
            break
        base, stop = int(own[0]), int(own[-1]) + width
        up, down = powers(kind, stop - base)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(keys[base:stop] * up[: stop - base], out=sums[1:])
        out[low : low + len(own)] = (sums[own - base + width] - sums[own - base]) * down[own - base]
    return mixed(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word numbers at which a window of ``width`` words fits into its text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first[:-1] - (ends - counts), counts)
