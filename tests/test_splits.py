import math

import pytest
from pyspark.sql import functions as F

from tesserae.operators import splits as sp


def placed(spark, n, **settings):
    rows = spark.range(n).select("id", (F.col("id") % 3).alias("g"))
    return sp.split(rows.repartition(5), ["id"], **settings).collect()


@pytest.mark.parametrize("n, up, down", [(30, 1, 1), (120, 3, 2), (1, 1, 1), (1000, 20, 20)])
def test_sizes(spark, n, up, down):
    for size, rule in ((up, sp.metadata_eval_size), (down, sp.sequence_eval_size)):
        rows = placed(spark, n, eval_size=rule)
        assert len(rows) == n
        for side, count in (("eval", size), ("train", n - size)):
            assert sorted(r["index"] for r in rows if r.split == side) == list(range(count))


def test_caps_and_zero_cap(spark):
    rows = placed(spark, 500, ratio=0.1, max_total=200, max_train=0, max_eval=7)
    assert sum(r.split == "train" for r in rows) == 180 and sum(r.split == "eval" for r in rows) == 7


def test_groups_and_seeds(spark):
    rows = placed(spark, 301, group=["g"], ratio=0.07)
    for g in range(3):
        mine = [r for r in rows if r.g == g]
        assert sum(r.split == "eval" for r in mine) == math.ceil(0.07 * len(mine))
    order = {s: [r.id for r in sorted(placed(spark, 100, seed=s), key=lambda r: (r.split, r["index"]))] for s in (1, 2)}
    assert order[1] != order[2] and sorted(order[1]) == sorted(order[2])
    assert order[1] == [r.id for r in sorted(placed(spark, 100, seed=1), key=lambda r: (r.split, r["index"]))]


def test_evaluation_cap(spark):
    rows = spark.range(10).withColumnRenamed("id", "index")
    assert [sp.first_rows(rows, n).count() for n in (None, 0, 3, 50)] == [10, 0, 3, 10]
