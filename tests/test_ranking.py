import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions.hashing import unit
from tesserae.operators.ranking import hash_rank, positions, running_start


def test_unit_is_the_leading_bits_of_the_digest(spark):
    got = spark.range(50).select("id", unit(5, F.lit("k"), "id").alias("u")).collect()
    for r in got:
        assert r.u == int(hashlib.md5(f"5:k:{r.id}".encode()).hexdigest()[:13], 16) / 2**52


def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 40}", rng.randrange(20), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, t int, i int").repartition(7)


def test_positions_split_hot_groups(spark):
    rows, frame = skewed(spark)
    expected, last = {}, {}
    for g, t, i in sorted(rows):
        last[g] = expected[i] = last.get(g, 0) + 1
    for limit in (10**6, 100, 0):
        got = positions(frame, ["g"], ["t", "i"], "pos", hot_rows=limit)
        assert {r.i: r.pos for r in got.collect()} == expected
        assert got.schema["pos"].dataType.simpleString() == "bigint"


def test_hot_group_is_spread_over_tasks(spark):
    _, frame = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(frame, ["g"], ["t", "i"], "pos", hot_rows=100)
        hot = got.filter("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(hot) > 3 and max(r["count"] for r in hot) < 1500


@pytest.mark.parametrize("digits", [1, 2, 3, 4])
def test_hash_rank(spark, digits):
    rows, frame = skewed(spark)
    got = hash_rank(frame, 9, ["i"], ["g"], "r", "n", digits=digits).collect()
    for g in {r[0] for r in rows}:
        ids = [r[2] for r in rows if r[0] == g]
        ids.sort(key=lambda i: hashlib.md5(f"9:{g}:{i}".encode()).hexdigest())
        mine = {x.i: x.r for x in got if x.g == g}
        assert mine == {i: k + 1 for k, i in enumerate(ids)}
        assert {x.n for x in got if x.g == g} == {len(ids)}


def test_hash_rank_without_groups(spark):
    rows, frame = skewed(spark)
    ids = sorted((r[2] for r in rows), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    for digits in (2, 5):
        got = hash_rank(frame, 9, ["i"], [], "r", "n", digits=digits).collect()
        assert {x.i: x.r for x in got} == {i: k + 1 for k, i in enumerate(ids)} and {x.n for x in got} == {len(ids)}


def test_running_start(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.randrange(1, 9)) for c in "ab" for i in range(1, 500)]
    frame = spark.createDataFrame(rows, "c string, i bigint, w bigint")
    got = running_start(frame, ["c"], "i", "w", "start", block=16).collect()
    total = {}
    expected = {}
    for c, i, w in sorted(rows):
        expected[c, i] = total.get(c, 0)
        total[c] = total.get(c, 0) + w
    assert {(r.c, r.i): r.start for r in got} == expected
