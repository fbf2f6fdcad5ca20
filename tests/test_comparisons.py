"""Prefix coherence, baseline codes and collision splits against plain Python, with hot tuples and odd rows."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import baselines as bl
from tesserae.operators import collisions as cl
from tesserae.operators import prefixes as px
from tesserae.plans import comparison

CODED = "k string, item bigint, label string, ids array<int>, embedding array<double>"


def coded_rows(seed=3, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ids = [1, 2, 3] if i % 3 == 0 else [rng.randrange(3) for _ in range(3)]
        vector = [rng.gauss(0, 1) for _ in range(4)]
        rows.append((rng.choice("ab"), i, rng.choice(("x", "y", None)), ids, vector))
    odd = [None, [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] + [1.0] * 3, [float("inf")] + [1.0] * 3]
    rows += [("a", n + i, "x", [1, 2, 3], v) for i, v in enumerate(odd)]
    rows += [("a", n + 10, "y", [1, 2, 3], [1e200] * 4), ("a", n + 11, "y", [1, 2, 3], [1e-200] * 4)]
    rows += [("a", n + 12, "x", [1, 2], [1.0] * 4), ("a", n + 13, "x", None, [1.0] * 4), ("b", n + 14, "z", [], None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(coded_rows() if rows is None else rows, CODED).repartition(4)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_purity(spark, keys):
    groups = defaultdict(Counter)
    for k, _, label, ids, _ in coded_rows():
        for length in range(1, len(ids or []) + 1):
            if label is not None:
                groups[(*([k] if keys else []), length, tuple(ids[:length]))][label] += 1
    rows = px.label_purity(frame(spark), 3, keys=keys)
    got = {(*[r[c] for c in keys], r.length, tuple(r.prefix)): r for r in rows.collect()}
    assert set(got) == set(groups)
    for key, labels in groups.items():
        n, row = sum(labels.values()), got[key]
        assert (row.n, row.n_labels) == (n, len(labels))
        assert row.purity == pytest.approx(max(labels.values()) / n)
        assert row.entropy == pytest.approx(-sum(c / n * math.log(c / n) for c in labels.values()), abs=1e-12)
    if not keys:
        for row in px.purity_by_length(rows).collect():
            mine = {key: c for key, c in groups.items() if key[0] == row.length}
            total = sum(sum(c.values()) for c in mine.values())
            assert (row.num_prefixes, row.num_items) == (len(mine), total)
            assert row.largest == max(sum(c.values()) for c in mine.values())
            assert row.purity == pytest.approx(sum(max(c.values()) for c in mine.values()) / total)


def unit_or_none(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
        return None
    v = np.array(vector) / max(map(abs, vector))
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_cosine_equals_all_pairs(spark, keys):
    groups = defaultdict(list)
    for k, _, _, ids, vector in coded_rows():
        unit = unit_or_none(vector)
        if ids is not None and len(ids) == 3 and unit is not None:
            for length in (1, 2, 3):
                groups[(*([k] if keys else []), length, tuple(ids[:length]))].append(unit)
    found = px.pair_cosine(frame(spark), 3, keys=keys)
    got = {(*[r[c] for c in keys], r.length, tuple(r.prefix)): r for r in found.collect()}
    assert set(got) == set(groups)
    every = defaultdict(list)
    for key, units in groups.items():
        pairs = [float(a @ b) for a, b in combinations(units, 2)]
        every[key[-2]] += pairs
        assert got[key].n == len(units)
        assert (got[key].cosine is None) if not pairs else got[key].cosine == pytest.approx(np.mean(pairs), abs=1e-9)
    if not keys:
        for row in px.cosine_by_length(found).collect():
            assert row.num_pairs == len(every[row.length])
            assert row.cosine == pytest.approx(np.mean(every[row.length]))


def test_no_codes(spark):
    assert px.label_purity(frame(spark, []), 3).collect() == [] and px.pair_cosine(frame(spark, []), 3).collect() == []
    lonely = frame(spark, [("a", 1, "x", [1, 1, 1], [1.0])])
    assert [r.cosine for r in px.cosine_by_length(px.pair_cosine(lonely, 3)).collect()] == [None] * 3


@pytest.mark.parametrize("domain", [1, 2, 3, 7, 16, 97, 250])
def test_permutation_is_one_to_one(spark, domain):
    rows = spark.range(domain).select("id", bl.permuted(F.col("id"), domain, 5).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(domain))
    if domain > 90:
        assert sum(r.id == r.p for r in rows) < domain / 10


@pytest.mark.parametrize("size, code_range", [(1, 90), (2, 9), (3, 5), (4, 3)])
def test_random_tuples_fill_the_space_without_collision(spark, size, code_range):
    domain = code_range**size
    numbers = spark.range(1, domain + 3).selectExpr("id AS n").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS n"))
    rows = bl.random_ids(numbers, "n", size, code_range, first=1).collect()
    tuples = [tuple(r.ids) for r in rows if r.ids is not None]
    assert len(tuples) == len(set(tuples)) == domain
    assert all(0 <= c < code_range and len(t) == size for t in tuples for c in t)
    assert {r.n for r in rows if r.ids is None} == {None, domain + 1, domain + 2}


def test_seeds_differ_and_draws_repeat(spark):
    drawn = lambda seed: [tuple(r.ids) for r in bl.random_ids(spark.range(200), "id", 3, 16, seed).orderBy("id").collect()]
    assert drawn(1) == drawn(1) != drawn(2)
    with pytest.raises(ValueError):
        bl.random_ids(spark.range(1), "id", 8, 256)


def test_hash_codes_depend_on_the_key_alone(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "key string, n int")
    got = {r.n: tuple(r.ids) for r in bl.hash_ids(rows, ["key"], 4, 64).collect()}
    assert got[1] == got[2] != got[3] and all(0 <= c < 64 for t in got.values() for c in t)


def no_wide_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_collisions_against_all_pairs(spark, keys):
    rng = random.Random(4)
    rows = [(r[0], r[1], r[2], r[3], None) for r in coded_rows()]
    coded = {}
    for k, item, _, ids, _ in rows:
        if ids is not None:
            coded[(k, item) if keys else (item,)] = tuple(ids[:2])
    named = sorted(coded)
    pairs = [(rng.choice("ab"), rng.choice(rows)[1], rng.choice(rows)[1]) for _ in range(3000)]
    pairs += [("a", 3, 3), ("a", 5, 9999), ("a", None, 3), ("b", 0, 3), ("b", 3, 0), (None, 1, 2)]
    may = {(*([k] if keys else []), *sorted((x, y))) for k, x, y in pairs if None not in (x, y) and x != y}
    want = defaultdict(lambda: [0, 0])
    for a, b in combinations(named, 2):
        if a[:-1] == b[:-1] and coded[a] == coded[b]:
            want[(*a[:-1], coded[a])][(*a[:-1], a[-1], b[-1]) not in may] += 1
    frame_of = spark.createDataFrame(pairs, "k string, first bigint, second bigint")
    # Repeated items change nothing.
    codes = frame(spark, rows + rows[:50])
    found = cl.tuple_collisions(codes, frame_of, 2, keys=keys)
    got = {(*[r[c] for c in keys], tuple(r.ids)): [r.benign, r.harmful] for r in found.collect()}
    assert got == dict(want) and no_wide_join(found)
    split = cl.collision_split(codes, frame_of, 2, keys=keys).collect()
    assert sum(r.benign for r in split) == sum(v[0] for v in want.values())
    assert sum(r.harmful for r in split) == sum(v[1] for v in want.values())
    assert sum(r.num_items for r in split) == len(coded)
    for row in split:
        assert row.harmful_rate == pytest.approx(row.harmful / row.pairs)


def test_a_third_of_all_items_in_one_tuple_is_never_expanded(spark):
    n = 30_000
    codes = spark.range(n).selectExpr("id AS item", "CASE WHEN id % 3 = 0 THEN array(0, 0) ELSE array(1, CAST(id AS int)) END AS ids")
    pairs = spark.range(0, 300, 3).selectExpr("id AS first", "id + 3 AS second")
    row = cl.collision_split(codes, pairs, 2).first()
    hot = n // 3
    assert (row.pairs, row.benign, row.harmful_items) == (hot * (hot - 1) // 2, 100, hot)


def test_no_items(spark):
    empty = spark.createDataFrame([], "item bigint, ids array<int>")
    pairs = spark.createDataFrame([(1, 2)], "first bigint, second bigint")
    assert cl.tuple_collisions(empty, pairs, 2).collect() == []
    alone = spark.createDataFrame([(1, [1, 1])], "item bigint, ids array<int>")
    row = cl.collision_split(alone, pairs, 2).first()
    assert (row.num_items, row.pairs, row.harmful, row.harmful_rate) == (1, 0, 0, 0.0)


def test_codes_beside_baselines(spark):
    """Codes that follow the labels are purer and closer than hashed and random ones, which never collide."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        label = i % 4
        vector = [rng.gauss(0, 0.1) + (3.0 if d == label else 0.0) for d in range(4)]
        rows.append((i, [label, rng.randrange(20)], f"l{label}", vector))
    coded = spark.createDataFrame(rows, "item bigint, ids array<int>, label string, embedding array<double>")
    pairs = spark.createDataFrame([(0, 4), (8, 4)], "first bigint, second bigint")
    got = {(r.source, r.length): r for r in comparison.compare_codes(coded, pairs, 2, 20).collect()}
    assert set(got) == {(s, n) for s in ("learned", "hash", "random") for n in (1, 2)}
    assert got["learned", 1].purity == 1.0 and got["learned", 1].cosine > 0.9
    assert all(got[s, 1].purity < 0.7 and got[s, 1].cosine < 0.6 for s in ("hash", "random"))
    assert all(got["random", n].collision_rate == got["random", n].harmful_rate == 0.0 for n in (1, 2))
    assert got["random", 2].uniqueness == 1.0 and got["hash", 2].uniqueness < 1.0
    sources = comparison.with_baselines(coded, "item", 2, 5)
    counts = {r.source: r.n for r in sources.filter("ids IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"learned": 120, "hash": 120, "random": 25}
