import random
from collections import Counter

import pytest

from tesserae.functions.fidelity import lcs_length
from tesserae.operators.reconstruction import score, summary


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def f1(common, n, m):
    if n == 0 and m == 0:
        return 1.0
    return 2 * common / (n + m) if common else 0.0


def test_lcs_against_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(90))]
        assert lcs_length(a, b) == plain_lcs(a, b) == lcs_length(b, a)


PREFIX = "The product name and/or its metadata are: "
PAIRS = [
    ("a a b", "a b b"), ("", ""), ("", "x"), ("x", "  "), ("A\x1cB", "a b"),
    (PREFIX + "Red Mug", "red  mug"), (" \n" + PREFIX + "x", "x"), (PREFIX.lower() + "x", "x"),
    (PREFIX.strip(), "x"), ("c b a", "a b c"), ("only this", "something else"), ("w " * 30_000, "v w " * 20_000),
]


def test_scores(spark):
    rng = random.Random(5)
    pairs = PAIRS + [
        (" ".join(rng.choices("abcdefg", k=rng.randrange(12))), " ".join(rng.choices("abcdefg", k=rng.randrange(12))))
        for _ in range(200)
    ]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, prediction string, reference string")
    scored = score(frame.repartition(5))
    for r in scored.collect():
        normal = []
        for text in (r.prediction, r.reference):
            text = text.strip()
            text = text.removeprefix(PREFIX)
            normal.append(" ".join(text.split()).lower())
        p, q = normal[0].split(), normal[1].split()
        assert r.recon_exact_match == float(normal[0] == normal[1]), r.id
        assert r.recon_token_f1 == pytest.approx(f1((Counter(p) & Counter(q)).total(), len(p), len(q)))
        common = 20_000 if len(p) == 30_000 else plain_lcs(p, q)
        assert r.recon_rouge_l == pytest.approx(f1(common, len(p), len(q)))
    worked = scored.filter("id = 0").first()
    assert worked.recon_token_f1 == worked.recon_rouge_l == pytest.approx(2 / 3)
    assert tuple(summary(score(frame.limit(0))).first()) == (0.0, 0.0, 0.0)
