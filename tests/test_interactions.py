import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ids
from tesserae.operators import interactions as it

SCHEMA = "category string, user string, item string, ts bigint, seq bigint"


def random_rows(seed, n=900, users=60, items=25, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "u0" if hot and rng.random() < 0.33 else f"u{rng.randrange(users)}"
        item = "i0" if hot and rng.random() < 0.33 else f"i{int(rng.paretovariate(0.6)) % items}"
        rows.append((rng.choice("ab"), user, item, rng.randrange(30), i))
    return rows


def plain_kcore(rows, user_core, item_core):
    while True:
        users = Counter((r[0], r[1]) for r in rows)
        items = Counter((r[0], r[2]) for r in rows)
        kept = [r for r in rows if users[r[0], r[1]] >= user_core and items[r[0], r[2]] >= item_core]
        if len(kept) == len(rows):
            return rows
        rows = kept


def test_worked_kcore(spark):
    pairs = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u3", "a"), ("u3", "c")]
    frame = spark.createDataFrame([("x", u, i, 0, n) for n, (u, i) in enumerate(pairs)], SCHEMA)
    assert it.drop_under_core(frame, 2, 2).count() == 5
    got = {(r.user, r.item) for r in it.kcore(frame, 2, 2).collect()}
    assert got == {("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b")}


@pytest.mark.parametrize("seed, cores", [(1, (5, 5)), (2, (8, 12)), (3, (12, 8)), (4, (40, 90))])
def test_kcore_against_plain_loop(spark, seed, cores):
    rows = random_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = it.kcore(frame, *cores)
    expected = plain_kcore(rows, *cores)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert it.is_kcore(got, *cores).first().is_kcore
    assert it.is_kcore(frame, *cores).first().is_kcore == (len(expected) == len(rows))


@pytest.mark.parametrize("seed, cores", [(1, (5, 5)), (3, (12, 8)), (4, (40, 90))])
def test_kcore_in_buckets(spark, seed, cores):
    rows = random_rows(seed)
    got = it.kcore(spark.createDataFrame(rows, SCHEMA).repartition(5), *cores, bucket_keys=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_kcore(rows, *cores))


@pytest.mark.parametrize("cores", [(5, 5), (40, 90), (1, 1)])
def test_few_rounds_put_no_edges_into_buckets(spark, monkeypatch, cores):
    def refused(*args):
        raise AssertionError("edges stored twice")

    rows = [("c", f"u{i % 20}", f"i{i % 7}", 0, i) for i in range(200)] + [("c", "once", "i0", 0, 300)]
    monkeypatch.setattr(it, "_bucketed", refused)
    got = it.kcore(spark.createDataFrame(rows, SCHEMA), *cores, bucket_keys=1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_kcore(rows, *cores))


def test_many_rounds_in_buckets(spark):
    # A chain from whose end one link falls in a round.
    rows = [("c", f"u{i + d}", f"i{i}", 0, 2 * i + d) for i in range(6) for d in (0, 1)]
    got = it.kcore(spark.createDataFrame([*rows, *[("c", f"k{i % 3}", f"j{i // 3}", 0, 50 + i) for i in range(9)]], SCHEMA), 2, 2, bucket_keys=2)
    assert sorted(r.seq for r in got.collect()) == list(range(50, 59))


def test_nulls_equal_no_fallen_key(spark):
    rows = [("c", "u", "i", 0, 0), ("c", None, "i", 0, 1), ("c", "u", None, 0, 2), ("c", None, None, 0, 3), (None, "u", "i", 0, 4)]
    got = it.kcore(spark.createDataFrame(rows, SCHEMA), 9, 9)
    assert sorted(r.seq for r in got.collect()) == [3, 4]


def test_a_part_of_a_known_table_is_numbered_in_one_pass(spark, monkeypatch):
    frame = spark.createDataFrame(random_rows(7), SCHEMA)
    part = frame.filter("seq % 3 > 0")
    want = {(r.seq, r.pos) for r in it.sequences(part, hot_rows=10).collect()}
    for limit in (10, 800):  # with groups above and below the limit
        assert {(r.seq, r.pos) for r in it.sequences(part, limit, within=frame).collect()} == want
    plan = it.sequences(part, 800, within=frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_user_ids_are_joined_once(spark):
    sequenced = it.sequences(spark.createDataFrame(random_rows(8), SCHEMA)).select("category", "user", "item", "pos")
    users = ids.user_ids(sequenced)
    named = ids.with_user_ids(sequenced, users)
    items = ids.item_ids(sequenced, users)
    assert sorted(ids.item_ids(named, users).collect()) == sorted(items.collect())
    assert sorted(ids.encode(named, users, items).collect()) == sorted(ids.encode(sequenced, users, items).collect())
    assert ids.with_user_ids(named, users) is named


def test_a_round_reads_the_buckets_of_fallen_keys_only(spark):
    rows = spark.createDataFrame(random_rows(6), SCHEMA)
    edges = it._bucketed(rows.groupBy("category", "user", "item").agg(F.count(F.lit(1)).alias("n")), 16)
    fallen = spark.createDataFrame([("user", "a", "u0"), ("user", "b", "u7")], "side string, category string, key string")
    touched = it._touched(edges, fallen, "user", 16)
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    # Bucket numbers as in the plan's filter: at most one per fallen key.
    assert len({r.bucket for r in touched.select("bucket").distinct().collect()}) <= 2
    want = {(r.category, r.user) for r in edges["user"].collect()} & {("a", "u0"), ("b", "u7")}
    assert {(r.category, r.user) for r in touched.collect()} == want
    assert it._touched(edges, fallen, "item", 16).count() == 0


def test_sequences_and_chunks(spark):
    rows = random_rows(5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        expected[r[0], r[1]].append(r[2])
    for hot_rows in (10**6, 50):
        placed = it.sequences(frame, hot_rows)
        got = defaultdict(list)
        lists = it.chunked(placed, it.USER, "pos", "item", "items", chunk=40).orderBy("chunk_no")
        for r in lists.collect():
            assert len(r["items"]) <= 40 and (len(got[r.category, r.user]) == 40 * r.chunk_no)
            got[r.category, r.user] += r["items"]
        assert got == expected


def test_stats(spark):
    rows = [("x", "u", "a", 0, 0), ("x", "u", "a", 1, 1), ("x", "v", "b", 0, 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    others = spark.createDataFrame([("x",), ("y",)], "category string")
    got = {r.category: r for r in it.dataset_stats(frame, others).collect()}
    assert tuple(got["x"]) == ("x", 2, 2, 3, 1.5, 25.0)
    assert tuple(got["y"]) == ("y", 0, 0, 0, None, 0.0)


def test_ids_walk_users_then_items(spark):
    rows = random_rows(6)
    for partitions in (1, 9):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        placed = it.sequences(frame)
        users = ids.user_ids(placed)
        items = ids.item_ids(placed, users, hot_rows=10)
        user_id = {(r.category, r.user): r.user_id for r in users.collect()}
        item_id = {(r.category, r.item): r.item_id for r in items.collect()}
        for category in "ab":
            own = sorted((v, k[1]) for k, v in user_id.items() if k[0] == category)
            assert [v for v, _ in own] == list(range(1, len(own) + 1))
            walked = {}
            for _, user in own:
                mine = [r for r in rows if r[:2] == (category, user)]
                for r in sorted(mine, key=lambda r: (r[3], r[4])):
                    walked.setdefault(r[2], len(walked) + 1)
            assert walked == {k[1]: v for k, v in item_id.items() if k[0] == category}
        encoded = ids.encode(placed, users, items)
        assert encoded.count() == len(rows)
        probability = it.popularity(encoded).groupBy("category").agg(F.sum("probability").alias("p"))
        assert all(abs(r.p - 1) < 1e-9 for r in probability.collect())
