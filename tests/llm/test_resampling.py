"""Weights, scores and ranks against plain Python, with small runs and segments."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import resampling as R
from tests.llm.cases import SCHEMA, frame, texts


def runs(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in side for f in runs(x)[1]) for side in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out, able = [], []
    for i, (doc_id, text, *_) in enumerate(docs):
        words, found = runs(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if len(words) >= least:
            able.append((-score, doc_id is None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[i][4] = rank + 1
    return out


def key(row):
    return tuple(str(v) for v in row)


def same(found, want):
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(map(tuple, want), key=key)


def targets(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


@pytest.mark.parametrize("settings", [R.Settings(), R.Settings(marks=24, segment_rows=4), R.Settings(percent=100, segment_rows=9)])
def test_resample_equals_brute_force(spark, settings):
    rows = texts(n=120)
    goal = [rows[5][1], "One two THREE zwölf", None, ""]
    found = R.resample(frame(spark, rows), targets(spark, goal), settings)
    same(found, brute(rows, goal, settings.percent))


def test_empty_corpus_and_empty_target(spark):
    assert R.resample(frame(spark, []), targets(spark, ["a b"])).collect() == []
    rows = texts(n=30)
    same(R.resample(frame(spark, rows), targets(spark, [])), brute(rows, []))


def test_ranks_with_ties_repeats_and_a_third_in_one_row(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(3)) for _ in range(600)] + [(7, 1)] * 300 + [(None, 1)] * 5
    found = spark.createDataFrame(rows, "doc_id bigint, score bigint").repartition(5)
    for draw in (0, 1, 450, 905):
        got = R.exact_ranks(found, draw, R.Settings(marks=40, segment_rows=50))
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        want = [(*r, i + 1 if i < draw else None) for i, r in enumerate(order)]
        same(got, want)


def test_text_ids(spark):
    rows = [(f"d{i}", " ".join(f"w{i}x{j}" for j in range(25))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    same(R.resample(docs, targets(spark, ["w1x1 w1x2"]), R.Settings(marks=8, segment_rows=2)), brute(rows, ["w1x1 w1x2"]))


def test_pair_checksums_go_on_from_words():
    count, found = R.features("Ab-c é9".encode(), 1 << 32)
    assert count == 3
    assert found.tolist() == [zlib.crc32(f.encode()) for f in ("ab", "c", "é9", "ab c", "c é9")]


def test_clashing_columns(spark):
    docs = spark.createDataFrame(texts(), SCHEMA).withColumns({c: F.lit("x") for c in ("row", "mark", "segment", "rank", "weight")})
    goal = ["a b c"]
    same(R.resample(docs, targets(spark, goal)), brute(texts(), goal))
