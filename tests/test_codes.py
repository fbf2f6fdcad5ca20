import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import codes as cd
from tesserae.plans import evaluation
from tesserae.sinks import reports


def frame(spark, rows):
    return spark.createDataFrame(rows, "category string, batch_id bigint, ids array<int>")


WORKED = [("x", 0, [0, 1]), ("x", 0, [0, 1]), ("x", 0, [2, -1])]


def test_worked_metrics(spark):
    row = cd.whole_quality(frame(spark, WORKED), 2, 4).first()
    assert row.codebook_perplexity == pytest.approx(2.8717, abs=1e-4)
    assert (row.active_codes, row.dead_codes, row.active_code_ratio) == (3, 1, 0.75)
    assert row.collision_rate == row.uniqueness == pytest.approx(2 / 3)
    assert (row.num_unique_ids, row.num_items, row.max_sharing) == (2, 3, 2)
    tuples = cd.tuple_counts(frame(spark, WORKED), 2)
    assert {(r.sharing, r.num_tuples) for r in cd.multiplicity_histogram(tuples).collect()} == {(1, 1), (2, 1)}
    histogram = cd.position_histogram(tuples)
    assert {(r.code, r.n) for r in histogram.filter("pos = 1").collect()} == {(-1, 1), (1, 2)}
    bars = {(r.pos, r.code): r.n for r in cd.position_bars(histogram, 2, 4).collect()}
    assert len(bars) == 8 and bars[0, 0] == 2 and bars[0, 3] == 0 and bars[1, 1] == 2


@pytest.mark.parametrize("rows, items", [([], 0), ([("x", 0, [-1, -1])] * 3, 3), ([("x", 0, [])] * 2, 2)])
def test_nothing_known(spark, rows, items):
    row = cd.whole_quality(frame(spark, rows), 2, 5).first()
    assert (row.codebook_perplexity, row.collision_rate, row.uniqueness) == (0.0, 0.0, 0.0)
    assert (row.active_codes, row.dead_codes, row.num_unique_ids, row.num_items) == (0, 5, 0, items)


def test_against_plain_counts(spark):
    rng = random.Random(8)
    hot = [3, 3, 3]
    rows = [
        (rng.choice("pq"), i // 64, hot if rng.random() < 0.33 else [rng.randrange(-1, 12) for _ in range(4)])
        for i in range(2000)
    ]
    codes = frame(spark, rows).repartition(6)
    got = {r.category: r for r in cd.quality(cd.with_all(cd.tuple_counts(codes, 3)), 12).collect()}
    for category in ("p", "q", cd.ALL):
        mine = [tuple(r[2][:3]) for r in rows if category in (r[0], cd.ALL)]
        usage = Counter(c for t in mine for c in t if c >= 0)
        total = sum(usage.values())
        entropy = -sum(n / total * math.log(n / total) for n in usage.values())
        tuples = Counter(mine)
        row = got[category]
        assert row.codebook_perplexity == pytest.approx(math.exp(entropy))
        assert row.collision_rate == pytest.approx(sum(n for n in tuples.values() if n > 1) / len(mine))
        assert (row.num_unique_ids, row.num_items) == (len(tuples), len(mine))
        assert row.max_sharing == max(tuples.values())
    health = {r.batch_id: r for r in cd.batch_health(codes, 3, 12).collect()}
    places = {(r.batch_id, r.pos): r.perplexity for r in cd.position_perplexity(codes, 3).collect()}
    for batch in range(2000 // 64):
        mine = [r[2] for r in rows if r[1] == batch]
        usage = Counter(c for t in mine for c in t if c >= 0)
        entropy = -sum(n / usage.total() * math.log(n / usage.total()) for n in usage.values())
        assert health[batch].perplexity == pytest.approx(math.exp(entropy))
        assert health[batch].diversity == pytest.approx(len(usage) / 12)
        assert health[batch].uniqueness == pytest.approx(len({tuple(t[:3]) for t in mine}) / len(mine))
        usage = Counter(t[1] for t in mine if t[1] >= 0)
        entropy = -sum(n / usage.total() * math.log(n / usage.total()) for n in usage.values())
        assert places[batch, 1] == pytest.approx(math.exp(entropy))


def test_most_shared_breaks_ties_by_tuple(spark):
    rows = [("x", 0, t) for t in ([2, 1], [1, 2], [1, 2], [0, 9], [2, 1], [5, 5])]
    top = cd.most_shared(cd.tuple_counts(frame(spark, rows), 2), 3).orderBy("place").collect()
    assert [(r.ids, r.n) for r in top] == [([1, 2], 2), ([2, 1], 2), ([0, 9], 1)]


def test_category_report(spark):
    rows = WORKED + [("y", 0, [1, 1])]
    indexed = frame(spark, rows).withColumn("index", F.lit(0))
    report = evaluation.evaluate_by_category(indexed, ["x", "y"], 2, 4, checkpoint="run1").first()
    assert (report.checkpoint, report.categories, report.codebook_size) == ("run1", ["x", "y"], 2)
    assert report["global"].num_items == 4 and set(report.per_category) == {"x", "y"}
    collapse = report.per_category["x"].collapse
    assert collapse.multiplicity_histogram == {"1": 1, "2": 1}
    assert collapse.max_products_sharing_one_id == 2
    assert [(t["tuple"], t["count"]) for t in collapse.most_shared_ids] == [([0, 1], 2), ([2, -1], 1)]
    assert report.per_category["x"].position_histograms["1"] == {"-1": 1, "1": 2}
    assert list(report["global"].position_histograms["0"]) == ["0", "1", "2"]
    empty = evaluation.evaluate_by_category(indexed, ["x", "gone"], 2, 4).first().per_category["gone"]
    assert (empty.num_items, empty.dead_codes, empty.collapse.max_products_sharing_one_id) == (0, 4, 0)
    assert (empty.collapse.most_shared_ids, empty.position_histograms) == ([], {"0": {}, "1": {}})
    nothing = evaluation.evaluate_by_category(indexed, ["x", "y"], 2, 4, max_samples=0).first()
    assert nothing["global"].num_items == 0 and set(nothing.per_category) == {"x", "y"}
    with pytest.raises(ValueError, match="stands for all"):
        evaluation.evaluate_by_category(indexed, [cd.ALL], 2, 4)
    none = evaluation.evaluate_codes(indexed, 2, 4, max_samples=0).first()
    assert none["eval/num_items"] == 0


def test_generate_rebuild_and_score(spark):
    """One pass from prompts to codes, texts, metrics, assignments and examples."""
    import json

    import numpy as np

    from tesserae.operators import items as im
    from tesserae.operators import reconstruction as rc

    rows = [(i, f"item {i % 4}", f"item {i % 4}. Features: soft") for i in range(10)]
    records = spark.createDataFrame(rows, "index bigint, product_name string, product_text string")
    records = im.with_prompts(records, "index", 2, 8)

    def make_codes():
        return lambda prompts: np.array([[100 + len(p) % 3, 100 + json.loads(p)[1]["content"].count("item 1"), 7] for p in prompts])

    def make_texts():
        def texts(asked):
            found = [json.loads(a) for a in asked]
            assert all(len(a["prompt"]) == 2 and len(a["ids"]) == 2 for a in found)
            return np.array([f"item {a['ids'][1]}. Features: soft" for a in found], dtype=object)

        return texts

    tokens = list(range(100, 108))
    metrics, assignments, examples = evaluation.generate_and_score(records, make_codes, make_texts, tokens, 2, max_samples=8, log_examples=3)
    row = metrics.first().asDict()
    assert row["eval/num_items"] == 8 and row["eval/active_codes"] >= 2 and 0 < row["eval/recon_exact_match"] < 1
    assert set(row) == {"eval/" + n for n in ("codebook_perplexity", "active_codes", "dead_codes", "active_code_ratio", "collision_rate", "uniqueness", "num_unique_ids", "num_items", *rc.METRICS)}
    named = assignments.collect()
    assert len(named) == 8 and all(r.semantic_id_tokens == [f"<|CODE_{c}|>" for c in r.semantic_ids] for r in named)
    shown = examples.collect()
    assert [r["index"] for r in shown] == [0, 1, 2] and shown[1].reference.endswith("item 1. Features: soft")


def test_assignments_keep_nulls(spark, tmp_path):
    rows = spark.createDataFrame([("n", [0, -1])], "product_name string, semantic_ids array<int>")
    reports.write_records(reports.assignments(rows), str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first().value
    assert line == '{"product_name":"n","semantic_ids":[0,-1],"semantic_id_tokens":["<|CODE_0|>",null]}'
