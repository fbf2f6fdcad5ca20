"""Ranking metrics against plain Python, with ties, repeats, odd scores and users without a side."""

import math
import random
from collections import defaultdict

import pytest

from tesserae.operators import recommendation as rm


def brute(ranked, relevant, cutoffs):
    scores, gains = defaultdict(dict), defaultdict(dict)
    for u, i, s in ranked:
        if u is not None and i is not None:
            s = None if s is None or math.isnan(s) else s
            old = scores[u].get(i)
            scores[u][i] = s if old is None else old if s is None else max(old, s)
    for u, i, g in relevant:
        if None not in (u, i, g) and g > 0:
            gains[u][i] = max(g, gains[u].get(i, 0))
    out = {}
    for u, wanted in gains.items():
        order = sorted(scores[u], key=lambda i: (scores[u][i] is None, -(scores[u][i] or 0), i))
        places = [p for p, i in enumerate(order, 1) if i in wanted]
        row = {"mrr": 1 / places[0] if places else 0.0, "n_relevant": len(wanted)}
        ideal = sorted(wanted.values(), reverse=True)
        for k in cutoffs:
            dcg = sum(wanted[i] / math.log2(p + 1) for p, i in enumerate(order[:k], 1) if i in wanted)
            n = sum(i in wanted for i in order[:k])
            row |= {
                f"recall_{k}": n / len(wanted),
                f"hit_{k}": float(n > 0),
                f"ndcg_{k}": dcg / sum(g / math.log2(p + 1) for p, g in enumerate(ideal[:k], 1)),
            }
        out[u] = row
    return out, {u for u in scores if scores[u]} - set(out)


def frames(spark, ranked, relevant):
    return (
        spark.createDataFrame(ranked, "user string, item int, score double").repartition(3),
        spark.createDataFrame(relevant, "user string, item int, gain double").repartition(3),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    users = [f"u{i}" for i in range(30)]
    # One user holds a third of all rows.
    pick = lambda: "u0" if rng.random() < 0.33 else rng.choice(users)
    odd = (None, float("nan"), 0.0, -1.0, float("inf"))
    ranked = [(pick(), rng.randrange(60), rng.choice((rng.randrange(4) * 1.0, rng.choice(odd)))) for _ in range(900)]
    ranked += [("only listed", 3, 1.0), (None, 3, 1.0), ("u1", None, 5.0)]
    relevant = [(pick(), rng.randrange(60), rng.choice((1.0, 2.0, 0.0, -1.0, None))) for _ in range(150)]
    relevant += [("only relevant", 5, 1.0), (None, 1, 1.0), ("u2", None, 1.0), ("only listed", 3, 0.0)]
    cutoffs = (1, 5, 20)
    want, unjudged = brute(ranked, relevant, cutoffs)
    pair = frames(spark, ranked, relevant)
    got = {r.user: r.asDict() for r in rm.per_user(*pair, cutoffs=cutoffs).collect()}
    assert set(got) == set(want)
    for user, row in want.items():
        for name, value in row.items():
            assert got[user][name] == pytest.approx(value), (user, name)
    for row in rm.ranking_metrics(*pair, cutoffs=cutoffs).collect():
        assert (row.num_users, row.num_unjudged) == (len(want), len(unjudged))
        for name in (*rm.METRICS, "mrr"):
            one = name if name == "mrr" else f"{name}_{row.k}"
            assert row[name] == pytest.approx(sum(w[one] for w in want.values()) / len(want))


def test_worked_example(spark):
    ranked = [("u", 1, 3.0), ("u", 2, 2.0), ("u", 3, 1.0)]
    row = rm.per_user(*frames(spark, ranked, [("u", 2, 1.0), ("u", 9, 1.0)]), cutoffs=(2,)).first()
    assert (row.recall_2, row.hit_2, row.mrr) == (0.5, 1.0, 0.5)
    assert row.ndcg_2 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_binary_relevance_without_a_gain_column(spark):
    ranked, relevant = frames(spark, [("u", 1, 1.0)], [("u", 1, 5.0), ("v", 1, 5.0)])
    rows = rm.ranking_metrics(ranked, relevant.drop("gain"), cutoffs=(5,)).collect()
    assert [(r.recall, r.hit, r.ndcg, r.mrr, r.num_users) for r in rows] == [(0.5, 0.5, 0.5, 0.5, 2)]


def test_empty_sides(spark):
    assert rm.ranking_metrics(*frames(spark, [], [])).collect() == []
    assert rm.ranking_metrics(*frames(spark, [("u", 1, 1.0)], [])).collect() == []
    rows = rm.ranking_metrics(*frames(spark, [], [("u", 1, 1.0)])).collect()
    assert {(r.k, r.recall, r.mrr, r.num_users, r.num_unjudged) for r in rows} == {(k, 0.0, 0.0, 1, 0) for k in rm.CUTOFFS}


def test_list_is_cut_before_the_shuffle(spark):
    ranked, relevant = frames(spark, [("u", i, float(i)) for i in range(50)], [("u", 1, 1.0)])
    plan = rm.per_user(ranked, relevant)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") and "CartesianProduct" not in plan and "NestedLoop" not in plan
