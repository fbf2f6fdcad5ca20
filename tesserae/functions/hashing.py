"""Reproducible randomness: every draw is a pure function of a seed and a key.

The reference draws from a sequential generator, so its output depends on processing order.
Here a draw is ``md5("seed:key:...")``, which any executor can recompute and which does not
depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds exactly.
_DIGITS = 13
_SCALE = float(16**_DIGITS)


def _columns(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def hash_key(seed, *keys) -> Column:
    """Hex digest of ``seed:key:...``; sorting by it is a seeded shuffle."""
    parts = [F.lit(str(seed))] + [c.cast("string") for c in _columns(keys)]
    return F.md5(F.concat_ws(":", *parts))


def unit(seed, *keys) -> Column:
    """Uniform double in [0, 1) for the key: the leading 52 bits of its digest.

    Never null by construction; saying so keeps Spark from adding null checks to join keys
    that would compute the digest again.
    """
    bits = F.conv(F.substring(hash_key(seed, *keys), 1, _DIGITS), 16, 10).cast("bigint")
    return F.coalesce(bits, F.lit(0)) * F.lit(1.0 / _SCALE)
