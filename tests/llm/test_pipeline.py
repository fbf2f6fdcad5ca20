"""Each stage of the pipeline against what its operator says of the stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import divergence, factorization, packing, simhash
from tests.llm.cases import sent, texts
from tests.llm.test_texts import BPE, classes, fingerprint, removed

SF = "/root/testdata/sf0.001"


def documents(spark):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in texts()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, docs, corpus_pipeline.store(stage(spark, docs, SF))))
        docs = found[-1][2]
    return {name: (before, after) for name, before, after in found}


def test_all_stages_but_the_last_return_documents(spark, steps):
    assert len(steps) == 5
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, (_, after) in list(steps.items())[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in schema], name
        assert after.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_filters_keep_what_their_operators_keep(spark, steps):
    before, after = steps["quality_rules"]
    kept = divergence.judge(before).filter("kept").select("doc_id").collect()
    assert sorted(kept) == sorted(after.select("doc_id").collect()) and after.count() < before.count()
    before, after = steps["quality_classifier"]
    corpus, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = factorization.score(corpus, labels).filter("predicted = 1").join(before, "doc_id", "left_semi")
    assert sorted(kept.select("doc_id").collect()) == sorted(after.select("doc_id").collect())
    good = labels.filter("quality = 1").join(before, "doc_id", "left_semi").join(after, "doc_id", "left_anti").count()
    assert good == 0


def brute_dedup(rows):
    marks = {fingerprint(t) for _, t in rows}
    group = classes(marks, [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3])
    return group


def test_one_document_of_each_class_stays(spark, steps):
    for before, after in (steps["near_dedup"], (documents(spark), None)):
        after = corpus_pipeline.near_dedup(spark, before, SF) if after is None else after
        rows = [(r.doc_id, r.text) for r in before.collect()]
        group = brute_dedup(rows)
        least = {}
        for i, t in rows:
            own = group[fingerprint(t)]
            order = (i is None, i or 0)
            least[own] = min(least.get(own, order), order)
        got = Counter((group[fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0)) for r in after.collect())
        assert got == Counter((g, i) for g, i in least.items())
        assert after.columns == before.columns


def test_near_dedup_sends_no_exploded_rows(spark, monkeypatch):
    plans = []

    def watched(df, label="step"):
        plans.extend(sent(df))
        return corpus_pipeline.store(df, label)

    monkeypatch.setattr(simhash, "store", watched)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans.extend(sent(corpus_pipeline.near_dedup(spark, docs, SF)))
    assert plans and not [x for x in plans if "Generate" in x]


def test_passages_go(spark, steps):
    for before, after in (steps["substring_dedup"], (documents(spark), None)):
        after = corpus_pipeline.substring_dedup(spark, before, SF) if after is None else after
        rows = [(r.doc_id, r.text, r.lang) for r in before.collect()]
        want = Counter((i, t if len(kept) == n else " ".join(kept)) for i, t, kept, n in removed(rows, 50))
        assert Counter((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()) == want


def test_last_stage_packs_every_piece(spark, steps):
    before, after = steps["best_fit_packing"]
    pieces = packing.pieces(before, BPE).collect()
    assert Counter(map(tuple, after.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, pieces))
    fills = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert fills.filter("n <> top OR n > 1024").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == after.count()


CLASHING = "_row row bin next fill _reference_of _language_reference fp k d h n kept words score at v"


def clashing(spark, rows=None):
    docs = documents(spark)
    docs = docs if rows is None else docs.filter("false")
    return docs.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHING.split()]).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    docs = clashing(spark, [])
    after = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert after.count() == 0 and (name == "best_fit_packing" or after.columns == docs.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_whole_odd_rows(spark, name):
    """Nulls, empty and long texts, ties, repeats and clashing names come through untouched, as without those columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = clashing(spark)
    after = stage(spark, docs, SF)
    assert after.columns == docs.columns
    got = after.collect()
    for row in got:
        assert all(row[c] == f"{c}{-1 if row.doc_id is None else row.doc_id}" for c in CLASHING.split())
    plain = stage(spark, documents(spark), SF)
    if name != "near_dedup":  # of rows with equal ids and texts any may stay
        assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter((r.doc_id, r.text, r.lang) for r in plain.collect())
    else:
        assert len(got) == plain.count()


def test_last_stage_packs_odd_rows(spark):
    rows = texts()
    after = corpus_pipeline.best_fit_packing(spark, clashing(spark), SF)
    assert after.filter("piece = 0").count() == len(rows)
    assert after.filter("doc_id = 122").select("start", "length").collect() == [(0, 1)]


def test_filters_decide_on_odd_rows(spark):
    docs = documents(spark)
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    want = {r.doc_id for r in divergence.judge(docs).filter("kept").collect()}
    assert kept == want and not kept & {122, 123, 124, 125}
    good = corpus_pipeline.quality_classifier(spark, docs, SF).count()
    assert 0 <= good <= docs.count()
