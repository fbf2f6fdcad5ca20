"""Stored counts of batches against the metrics of all codes at once."""

import random

import pytest

from tesserae.operators import codes as cd
from tesserae.plans.accumulation import CodeCounts
from tesserae.workspace import new_path

SCHEMA = "category string, ids array<int>"


def rows_of(seed, n=80):
    rng = random.Random(seed)
    return [(rng.choice("pq"), [5, 5] if i % 3 == 0 else [rng.randrange(-1, 6) for _ in range(2)]) for i in range(n)]


def plain(df):
    """Rows in order; the last digits of a sum depend on its order."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def fill(spark, state, batches):
    for name, rows in batches.items():
        state.add(spark.createDataFrame(rows, SCHEMA), name)


def whole(spark, batches):
    rows = [r for b in batches.values() for r in b]
    return cd.quality(cd.with_all(cd.tuple_counts(spark.createDataFrame(rows, SCHEMA), 2)), 6)


BATCHES = {"day 1/a": rows_of(1), "b[2]": rows_of(2), "c=%3": rows_of(3), "empty": []}


def test_batches_equal_the_whole(spark):
    state = CodeCounts(spark, new_path(spark, "counts"), size=2)
    fill(spark, state, BATCHES)
    assert plain(state.quality(6)) == plain(whole(spark, BATCHES))
    usage = cd.position_histogram(cd.tuple_counts(spark.createDataFrame([r for b in BATCHES.values() for r in b], SCHEMA), 2))
    assert plain(state.usage()) == plain(usage)


def test_replays_replace_and_broken_attempts_do_not_count(spark):
    state = CodeCounts(spark, new_path(spark, "counts"), size=2)
    state.add(spark.createDataFrame(rows_of(9), SCHEMA), "b[2]")
    fill(spark, state, BATCHES)
    fill(spark, state, {"day 1/a": BATCHES["day 1/a"]})
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state.folders[0]}/batch=c%253D%25253/attempt=9/part-0.parquet")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
    assert plain(state.quality(6)) == plain(whole(spark, BATCHES))


def test_states_merge(spark):
    one, two = (CodeCounts(spark, new_path(spark, "counts"), size=2) for _ in range(2))
    fill(spark, one, {"day 1/a": rows_of(8), "b[2]": BATCHES["b[2]"]})
    fill(spark, two, {k: BATCHES[k] for k in ("day 1/a", "c=%3")})
    both = CodeCounts(spark, *one.folders, *two.folders, size=2)
    assert plain(both.quality(6)) == plain(whole(spark, {k: BATCHES[k] for k in ("day 1/a", "b[2]", "c=%3")}))
    assert {r.batch: r.num_items for r in both.trend(6).collect()} == {"day%201%2Fa": 80, "b%5B2%5D": 80, "c%3D%253": 80}


def test_nothing_added(spark):
    with pytest.raises(ValueError):
        CodeCounts(spark, new_path(spark, "counts"), size=2).tuples()
