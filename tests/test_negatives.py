import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import negatives as ng
from tesserae.sources.artifacts import token_lists

SCHEMA = "category string, user_id bigint, pos bigint, item_id bigint"


def encoded(spark, users=40, items=60, seed=0):
    """User 1 has a third of all rows, user 2 has seen everything, user 3 all but two items."""
    rng = random.Random(seed)
    rows = []
    for c in ("a", "b"):
        seqs = {u: [rng.randrange(1, items + 1) for _ in range(8)] for u in range(4, users)}
        seqs[1] = [rng.randrange(1, items // 2) for _ in range(250)]
        seqs[2] = list(range(1, items + 1))
        seqs[3] = list(range(3, items + 1))
        rows += [(c, u, p, i) for u, seq in seqs.items() for p, i in enumerate(seq)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode", ["random", "pop"])
@pytest.mark.parametrize("k", [5, 99])
def test_distinct_unseen_and_complete(spark, mode, k):
    rows, frame = encoded(spark)
    seen = defaultdict(set)
    for c, u, _, i in rows:
        seen[c, u].add(i)
    got = defaultdict(list)
    for r in ng.sample_negatives(frame, k, mode=mode).orderBy("neg_pos").collect():
        got[r.category, r.user_id].append(r.item_id)
        assert r.neg_pos == len(got[r.category, r.user_id])
    for key, own in seen.items():
        assert len(got[key]) == min(k, 60 - len(own)), key
        assert len(set(got[key])) == len(got[key]) and not own & set(got[key])
    assert not got["a", 2] and sorted(got["a", 3]) == [1, 2]


def test_independent_of_partitioning_and_rounds(spark):
    _, frame = encoded(spark)
    wanted = sorted(tuple(r) for r in ng.sample_negatives(frame, 30).collect())
    again = sorted(tuple(r) for r in ng.sample_negatives(frame.repartition(11), 30).collect())
    assert wanted == again
    longer = sorted(tuple(r) for r in ng.sample_negatives(frame, 45).collect() if r.neg_pos <= 3)
    assert [r for r in wanted if r[2] <= 3] == longer


def test_blocks_of_the_pool(spark, monkeypatch):
    _, frame = encoded(spark)
    whole = sorted(tuple(r) for r in ng.sample_negatives(frame, 50, mode="pop").collect())
    monkeypatch.setattr(ng, "BLOCK", 4)
    monkeypatch.setattr(ng, "BROADCAST_ITEMS", 0)
    assert whole == sorted(tuple(r) for r in ng.sample_negatives(frame, 50, mode="pop").collect())


def test_popular_items_are_drawn_more(spark):
    rows = [("a", u, 0, 1) for u in range(1, 400)] + [("a", 500 + i, 0, i) for i in range(2, 60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    first = {}
    for mode in ("random", "pop"):
        picks = ng.sample_negatives(frame, 3, mode=mode).filter("user_id > 500 AND neg_pos = 1").collect()
        first[mode] = Counter(r.item_id for r in picks)[1]
        assert len(picks) == 58
    assert first["pop"] > 40 > 10 > first["random"]


def test_records(spark):
    _, frame = encoded(spark)
    sequences = spark.createDataFrame([("a", 1, 0, [5]), ("a", 2, 0, [6])], "category string, user_id bigint, chunk_no bigint, item_ids array<bigint>")
    negatives = spark.createDataFrame([("a", 1, 0, [9])], "category string, user_id bigint, chunk_no bigint, neg_items array<bigint>")
    got = {r.user_id: r.neg_items for r in ng.sequence_records(sequences, negatives).collect()}
    assert got == {1: [9], 2: []}


def test_records_keep_chunks_that_one_side_lacks(spark):
    schema = "category string, user_id bigint, chunk_no bigint, {} array<bigint>"
    sequences = [("a", 1, 0, [5, 6]), ("a", 2, 0, [1, 2, 3]), ("a", 2, 1, [4])]
    negatives = [("a", 1, 0, [7, 8, 9]), ("a", 1, 1, [10, 11, 12]), ("a", 1, 2, [13]), ("a", 3, 0, [1])]
    frames = [spark.createDataFrame(r, schema.format(n)) for r, n in ((sequences, "item_ids"), (negatives, "neg_items"))]
    records = ng.whole_records(ng.sequence_records(*frames)).collect()
    got = {r.user_id: (r.item_ids, r.neg_items) for r in records}
    assert got == {1: ([5, 6], [7, 8, 9, 10, 11, 12, 13]), 2: ([1, 2, 3, 4], [])}


def test_rounds_of_new_slots_past_the_pool(spark, monkeypatch):
    rows, frame = encoded(spark)
    seen = {(c, u, i) for c, u, _, i in rows}
    for first in (2, 7, 500):
        monkeypatch.setattr(ng, "first_slots", lambda k, first=first: first)
        for mode in ("random", "pop"):
            got = ng.sample_negatives(frame, 40, mode=mode).collect()
            users = Counter((r.category, r.user_id) for r in got)
            assert len({(r.category, r.user_id, r.item_id) for r in got} - seen) == len(got)
            assert {(r.category, r.user_id, r.neg_pos) for r in got} == {(*u, p) for u, n in users.items() for p in range(1, n + 1)}
            assert all(users[u] == min(40, 60 - n) for u, n in Counter((c, u) for c, u, _ in {(c, u, i) for c, u, _, i in rows}).items() if n < 60)
    candidates = frame.select("category", "user_id", F.lit(1).cast("bigint").alias("item_id")).distinct()
    left = {(r.category, r.user_id) for r in ng.unseen_only(candidates, frame).collect()}
    assert ("a", 2) not in left and ("a", 3) in left


@pytest.mark.parametrize("mode", ["random", "pop"])
def test_draws_before_the_first_slots_change_no_pick(spark, monkeypatch, mode):
    _, frame = encoded(spark, items=400)
    monkeypatch.setattr(ng, "ample_items", lambda k: 10**9)
    whole = sorted(tuple(r) for r in ng.sample_negatives(frame, 5, mode=mode).collect())
    monkeypatch.undo()
    monkeypatch.setattr(ng, "ample_items", lambda k: 0)
    assert whole == sorted(tuple(r) for r in ng.sample_negatives(frame, 5, mode=mode).collect())
    assert whole == sorted(tuple(r) for r in ng.sample_negatives(frame, 5, mode=mode, hot_rows=9).collect())


def test_draws_are_not_shuffled(spark):
    rows = [("a", u, p, u * 5 + p) for u in range(40) for p in range(1, 6)]
    frame = ng.store(spark.createDataFrame(rows, SCHEMA), "seen")
    users = frame.groupBy(*ng.USER_ID).agg(F.count(F.lit(1)).alias("own")).select(
        "*", *[F.lit(n).cast("bigint").alias(name) for name, n in (("target", 5), ("got", 0), ("first", 0), ("slots", 9), ("mass", 200))]
    )
    taken = ng._take(ng._unseen(ng.store(users, "users"), None, False, frame, 100, 1), 5, "slot")
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_seen_pairs_are_not_broadcast(spark):
    frame = ng.store(spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 2), ("b", 2, 1, 1)], SCHEMA), "encoded")
    candidates = frame.select("category", "user_id", (F.col("item_id") + 1).alias("item_id"))
    rest = ng.unseen_only(candidates, frame)
    assert sorted(tuple(r) for r in rest.collect()) == [("a", 1, 3), ("b", 2, 2)]
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()


def test_records_with_sides_shuffle_lists_once(spark):
    sequences = spark.createDataFrame([("c", u, n, [f"{u}{n}"]) for u in "ab" for n in (0, 1)], "category string, user_id string, chunk_no bigint, item_ids array<string>")
    negatives = spark.createDataFrame([("c", "a", 0, ["x"]), ("c", "b", 5, ["y"]), ("c", "none", 0, ["z"])], "category string, user_id string, chunk_no bigint, neg_items array<string>")
    sides = spark.createDataFrame([("c", "a", "train"), ("c", "b", "eval")], "category string, user_id string, split string")
    got = ng.sequence_records(sequences, negatives, sides)
    want = ng.sequence_records(sequences, negatives).join(sides, ["category", "user_id"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 5
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_cut_after_their_lines_met(spark):
    rows = [("c", 0, 1, " u1 a b "), ("c", 0, 2, "u1 a  c"), ("c", 1, 1, "u1 d"), ("c", 0, 3, "u2"), ("c", 0, 4, None), ("c", 0, 5, "")]
    lists = token_lists(spark.createDataFrame(rows, "category string, chunk_no bigint, seq bigint, value string"), "user_id", "ids")
    assert sorted(tuple(r) for r in lists.collect()) == [("c", "u1", 0, ["a", "", "c"]), ("c", "u1", 1, ["d"])]
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("split(") < plan.index("Aggregate")  # plans are printed from the last step to the first
    assert "split(" not in plan[plan.index("Aggregate"):]
