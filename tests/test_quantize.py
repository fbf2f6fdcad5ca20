import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tesserae.operators import quantize as qz

cloudpickle.register_pickle_by_value(sys.modules[__name__])
BOOK = "level int, code int, centroid array<double>"


def vectors(spark, n=300, dim=6, seed=0):
    points = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return points.astype("float64"), spark.createDataFrame(rows, "id int, embedding array<float>").repartition(4)


def book(levels, codes, dim, seed=1):
    return np.random.default_rng(seed).normal(size=(levels, codes, dim)) * (0.5 ** np.arange(levels))[:, None, None]


def book_frame(spark, centroids):
    rows = [(lv, c, [float(x) for x in v]) for lv, level in enumerate(centroids) for c, v in enumerate(level)]
    return spark.createDataFrame(rows, BOOK).repartition(3)


def plain_codes(points, centroids):
    rest, codes = points.copy(), []
    for level in centroids:
        distance = ((rest[:, None, :] - level[None]) ** 2).sum(-1)
        codes.append(distance.argmin(1))
        rest -= level[codes[-1]]
    return np.array(codes).T.tolist(), rest


@pytest.mark.parametrize("slice_bytes", [1 << 20, 6 * 8 * 3])
def test_codes_and_decoding(spark, slice_bytes):
    points, frame = vectors(spark)
    centroids = book(3, 8, 6)
    centroids[1, 5] = centroids[1, 2]  # an exact tie goes to the lower code
    codebook = book_frame(spark, centroids)
    coded = qz.residual_codes(frame, codebook, 3, slice_bytes=slice_bytes)
    expected, rest = plain_codes(points, centroids)
    errors = {r.id: r for r in qz.reconstruction_error(coded).collect()}
    rebuilt = {r.id: r.rebuilt for r in qz.decode(coded.select("id", "ids"), codebook, 3).collect()}
    for i, codes in enumerate(expected):
        assert errors[i].ids == codes
        assert errors[i].squared_error == pytest.approx((rest[i] ** 2).sum())
        assert rebuilt[i] == pytest.approx(list(points[i] - rest[i]))
        source, near = points[i], points[i] - rest[i]
        assert errors[i].cosine == pytest.approx(source @ near / np.sqrt((source @ source) * (near @ near)))


def test_far_codes_are_pruned_and_exact(spark):
    """Clustered centroids, of which most groups are out of reach; a third of the points are equal."""
    rng = np.random.default_rng(7)
    homes = rng.normal(size=(12, 5)) * 40
    centroids = (homes[:, None, :] + rng.normal(size=(12, 25, 5))).reshape(1, -1, 5)
    centroids[0, 7] = centroids[0, 290] = centroids[0, 31]  # exact ties far apart in code order
    points = homes[rng.integers(0, 12, 400)] + rng.normal(size=(400, 5))
    points[:140] = centroids[0, 31]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, embedding array<double>")
    expected, _ = plain_codes(points, centroids)
    book_rows = book_frame(spark, centroids)
    for point_rows in (qz.POINT_ROWS, 50):
        state = frame.selectExpr("id", "embedding AS residual")
        level = qz.store(book_rows.select("code", "centroid"))
        best = qz.far_choice(state, level, 300, 25, point_rows)
        got = {r.id: r._best for r in best.collect()}
        assert {i: [b.code] for i, b in got.items()} == dict(enumerate(expected))
        assert all(list(b.chosen) == centroids[0, b.code].tolist() for b in got.values())
    pivots = homes[:, :]
    groups = {g: (1, 0.0, 6.0) for g in range(12)}
    reach = frame.select(F.size(qz._reachable(spark, pivots, groups)(F.col("embedding"))).alias("n"))
    assert reach.agg(F.avg("n")).first()[0] < 3


def test_far_codes_of_no_points(spark):
    _, frame = vectors(spark, 4)
    none = frame.withColumn("embedding", F.lit(None).cast("array<float>"))
    got = qz.residual_codes(none, book_frame(spark, book(2, 9, 6)), 2, slice_bytes=6 * 8 * 2)
    assert [r.ids for r in got.collect()] == [None] * 4
    assert qz.residual_codes(none.limit(0), book_frame(spark, book(1, 9, 6)), 1, slice_bytes=6 * 8 * 2).collect() == []


def test_null_vectors_and_gaps_between_codes(spark):
    points, frame = vectors(spark)
    some = frame.withColumn("embedding", F.when(F.col("id") % 3 > 0, F.col("embedding")))
    centroids = book(1, 6, 6)
    gaps = book_frame(spark, centroids).withColumn("code", F.col("code") * 5)
    for slice_bytes in (1 << 20, 6 * 8 * 2):
        got = {r.id: r.ids for r in qz.residual_codes(some, gaps, 1, slice_bytes=slice_bytes).collect()}
        expected, _ = plain_codes(points, centroids)
        assert got == {i: [5 * codes[0]] if i % 3 else None for i, codes in enumerate(expected)}
    short = frame.withColumn("embedding", F.slice("embedding", 1, 5))
    with pytest.raises(Exception, match="another length"):
        qz.residual_codes(short, gaps, 1).collect()


def python_steps(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


@pytest.mark.parametrize("slice_bytes, maps", [(3 * 8 * 6 * 8, 1), (2 * 8 * 6 * 8, 2), (8 * 6 * 8, 3)])
def test_levels_share_a_python_worker(spark, slice_bytes, maps):
    """Also below an explode of the codes, for which Spark infers a filter on them."""
    points, frame = vectors(spark)
    centroids = book(3, 8, 6)
    coded = qz.residual_codes(frame, book_frame(spark, centroids), 3, slice_bytes=slice_bytes)
    assert python_steps(coded.select(F.posexplode("ids")).groupBy("pos").count()) == maps
    expected, rest = plain_codes(points, centroids)
    got = {r.id: r for r in coded.collect()}
    assert [got[i].ids for i in range(len(points))] == expected
    assert [got[i].residual for i in range(len(points))] == rest.tolist()


def test_centroids_of_the_driver_pass_through_no_python_worker(spark):
    _, frame = vectors(spark, 40)
    for book_rows in (qz._one_level(spark, {3: [1.0, None], 1: [0.5, 2.0]}), qz.fit_codebook(frame, 2, 3, max_iter=1)):
        assert "LocalTableScan" in book_rows._jdf.queryExecution().executedPlan().toString()
        assert book_rows.dtypes == [("level", "int"), ("code", "int"), ("centroid", "array<double>")]
    got = qz._one_level(spark, {3: [1.0, None], 1: [0.5, 2.0]}).collect()
    assert [tuple(r) for r in got] == [(0, 1, [0.5, 2.0]), (0, 3, [1.0, None])]
    assert qz._one_level(spark, {}).collect() == []


def test_null_and_nan_components_stay(spark):
    rows = [(0, [1.0, None]), (1, None), (2, [4.0, 4.0]), (3, [4.0, float("nan")])]
    frame = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(1)
    codebook = spark.createDataFrame([(0, 0, [1.0, 1.0]), (0, 1, [4.0, 3.0]), (1, 0, [0.5, 0.5])], BOOK)
    got = {r.id: (r.ids, str(r.residual)) for r in qz.residual_codes(frame, codebook, 2).collect()}
    assert got == {
        0: ([0, 0], "[-0.5, None]"), 1: (None, "None"), 2: ([1, 0], "[-0.5, 0.5]"), 3: ([0, 0], "[2.5, nan]")
    }


def test_blocks_of_points_and_codes(monkeypatch):
    rng = np.random.default_rng(0)
    points, centroids = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    centroids[20] = centroids[3]
    whole = qz.nearest(points, centroids)
    monkeypatch.setattr(qz, "POINT_BLOCK", 7)
    monkeypatch.setattr(qz, "CODE_BLOCK", 4)
    cut = qz.nearest(points, centroids)
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])


def test_missing_level(spark):
    _, frame = vectors(spark, 5)
    with pytest.raises(ValueError, match="no level 1"):
        qz.residual_codes(frame, book_frame(spark, book(1, 2, 6)), 2)


def test_unknown_code_adds_nothing(spark):
    codebook = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [0.5, 0.5])], BOOK)
    codes = spark.createDataFrame([(1, [0, 0]), (2, [-1, 0]), (3, [0, -1])], "id int, ids array<int>")
    got = {r.id: r.rebuilt for r in qz.decode(codes, codebook, 2).collect()}
    assert got == {1: [1.5, 2.5], 2: [0.5, 0.5], 3: [1.0, 2.0]}


def test_fit_lowers_the_error(spark):
    _, frame = vectors(spark, 200)
    codebook = qz.fit_codebook(frame, 3, 4, max_iter=5)
    means = []
    for levels in (1, 2, 3):
        error = qz.reconstruction_error(qz.residual_codes(frame, codebook, levels))
        means.append(error.agg(F.avg("squared_error")).first()[0])
    assert means[0] > means[1] > means[2]


def test_unused_centers_are_revived(spark):
    points = spark.createDataFrame([([float(x), 0.0],) for x in (0, 0, 0, 1, 2, 10, 11, 12, 13)], "v array<double>")
    far = {0: [0.0, 0.0], 1: [500.0, 0.0], 2: [0.0, 0.0], 3: [11.0, 0.0], 5: [-900.0, 3.0]}
    error = lambda centers: sum(r.error for r in qz.cell_loads(points, centers).collect())
    got = qz.revived(points, far, 6, 20)
    assert sorted(got) == list(range(6))
    assert {r.code for r in qz.cell_loads(points, got).collect()} == set(range(6))
    assert error(got) < error(far)
    # Seven distinct places cannot use ten codes.
    assert len(qz.revived(points, far, 10, 50)) == 7


def test_every_code_of_a_fit_is_used(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=3).tolist(),) for _ in range(150)] + [([5.0, 5.0, 5.0],)] * 75 + [(None,)]
    frame = spark.createDataFrame(rows, "embedding array<double>")
    book_rows = qz.store(qz.fit_codebook(frame, 2, 40, max_iter=2))
    coded = qz.residual_codes(frame.filter("embedding IS NOT NULL"), book_rows, 2)
    loads = coded.select(F.posexplode("ids").alias("level", "code")).groupBy("level").agg(F.count_distinct("code").alias("n"))
    assert {r.level: r.n for r in loads.collect()} == {0: 40, 1: 40}


def make_predict():
    import json

    import numpy as np

    def predict(prompts):
        assert len(prompts) <= 7
        sizes = [len(json.loads(p)[0]["content"]) for p in prompts]
        return np.array([[100 + n, 101, 999, 100] for n in sizes])

    return predict


def test_generate(spark):
    rows = [(i, [("user", "x" * (i % 4))]) for i in range(40)]
    prompts = spark.createDataFrame(rows, "id int, p array<struct<role string, content string>>").repartition(3)
    out = qz.generate(prompts, make_predict, [100, 101, 102], 3, "p", batch_size=7).collect()
    assert len(out) == 40
    for r in out:
        first = r.id % 4 if r.id % 4 < 3 else -1
        assert r.semantic_ids == [first, 1, -1]
        assert r.semantic_id_text == f"<|bos_semantic|>{first},1,-1<|eos_semantic|>"
        assert r.semantic_id_tokens == [f"<|CODE_{first}|>" if first >= 0 else None, "<|CODE_1|>", None]
