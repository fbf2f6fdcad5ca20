"""Codes without meaning, to compare learned ones with: hashed tuples, and random ones that never collide.

Both are column expressions over a row's own key or number: no shuffle, no collect, no state.
"""

from __future__ import annotations

from math import ceil, isqrt, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.hashing import unit

SEED = 42
ROUNDS = 6


def hash_ids(items: DataFrame, key: list[str], size: int, code_range: int, seed: int = SEED, name: str = "ids") -> DataFrame:
    """Adds ``size`` codes below ``code_range``, drawn from the digest of (seed, key, position); equal keys agree."""
    drawn = [F.floor(unit(seed, *key, F.lit(p)) * code_range).cast("int") for p in range(size)]
    return items.withColumn(name, F.array(*drawn))


def permuted(number: Column, domain: int, seed: int = SEED, parts: tuple[int, int] | None = None) -> Column:
    """A keyed permutation of 0 .. ``domain`` - 1 in mixed radix.

    A number is split into two digits of radix a and b, and in turn each digit is shifted by a draw
    that depends on the other one, which is reversible. Where a * b exceeds the domain, results
    outside of it are permuted again until they fall inside; a cycle meets each number outside at
    most once, which bounds the steps.
    """
    a, b = parts or (ceil(domain / (isqrt(max(domain - 1, 0)) + 1)), isqrt(max(domain - 1, 0)) + 1)

    def step(value: Column) -> Column:
        digits = [F.floor(value / b), F.pmod(value, F.lit(b))]
        for r in range(ROUNDS):
            own, other, radix = (0, 1, a) if r % 2 == 0 else (1, 0, b)
            shift = F.floor(unit(seed, F.lit(r), digits[other]) * radix)
            digits[own] = F.pmod(digits[own] + shift, F.lit(radix))
        return digits[0] * b + digits[1]

    once = step(number.cast("bigint"))
    outside = a * b - domain
    if not outside:
        return once
    again = F.sequence(F.lit(1), F.lit(outside + 1))
    return F.aggregate(again, once, lambda v, _: F.when(v < domain, v).otherwise(step(v)))


def random_ids(
    items: DataFrame, number: str, size: int, code_range: int, seed: int = SEED, name: str = "ids", first: int = 0
) -> DataFrame:
    """Adds ``size`` codes below ``code_range`` to rows with dense numbers from ``first``; no two numbers share a tuple.

    The tuples are a random choice of all ``code_range ** size``, in random order. Numbers outside
    of that many, and null ones, get null codes.
    """
    domain = code_range**size
    if domain >= 1 << 52:
        raise ValueError("there are more tuples than numbers that a draw tells apart")
    half = size // 2
    parts = (code_range**half, code_range ** (size - half)) if half else None
    place = F.col(number).cast("bigint") - first
    value = permuted(place, domain, seed, parts)
    digits = [F.pmod(F.floor(value / prod([code_range] * p)), F.lit(code_range)).cast("int") for p in range(size - 1, -1, -1)]
    return items.withColumn(name, F.when((place >= 0) & (place < domain), F.array(*digits)))
