"""Token overlap and longest common subsequence of two normalised texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b) -> int:
    """Bit-parallel longest common subsequence (Hyyro 2004).

    One big integer holds a dynamic-programming row, so a row costs len(b)/64 word operations.
    """
    if len(a) == 0 or len(b) == 0:
        return 0
    places: dict[str, int] = {}
    for j, token in enumerate(b):
        places[token] = places.get(token, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _words(texts: pa.Array) -> Iterator[list[str]]:
    """Tokens of normalised texts, one text at a time: words take ten times the memory of the batch.

    Whole texts cross to Python faster than arrays of words.
    """
    return ((text.as_py() or "").split() for text in texts)


@F.arrow_udf(T.LongType())
def lcs_tokens(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(_words(a), _words(b))
    return pa.array([lcs_length(x, y) for x, y in pairs], pa.int64())


@F.arrow_udf(T.LongType())
def shared_tokens(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the multiset intersection, per row and so without a shuffle of tokens."""
    pairs = zip(_words(a), _words(b))
    return pa.array([(Counter(x) & Counter(y)).total() for x, y in pairs], pa.int64())


def f1_score(common, predicted, expected) -> Column:
    """Harmonic mean of common/predicted and common/expected.

    Both sides empty score 1, otherwise nothing in common scores 0.
    """
    common, predicted, expected = F.col(common), F.col(predicted), F.col(expected)
    precision, recall = common / predicted, common / expected
    return (
        F.when((predicted == 0) & (expected == 0), F.lit(1.0))
        .when((predicted == 0) | (expected == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )
