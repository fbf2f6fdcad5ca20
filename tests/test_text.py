import random
import re
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text as tx
from tesserae.functions.prompts import TEMPLATES, guessing_prompt, reconstruction_prompt, without_answer


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_whitespace_is_that_of_python_strings(spark):
    points = [i for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    frame = spark.createDataFrame([(i, f" a{chr(i)}{chr(i)}b{chr(i)}") for i in points[::7] + list(range(1, 0x3100))], "i int, t string")
    for r in frame.select("t", tx.clean("t").alias("c"), tx.strip("t").alias("s")).collect():
        assert r.c == re.sub(r"\s+", " ", r.t).strip()
        assert r.s == r.t.strip()


def test_stringify_by_type(spark):
    nested = T.StructType().add("a", T.StringType()).add("m", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    schema = T.StructType().add("x", T.ArrayType(nested)).add("b", T.BooleanType()).add("d", T.DoubleType()).add("n", T.StringType())
    row = ([(" p ", {"k": ["q", None, " r"]}), None], True, 3.0, None)
    frame = spark.createDataFrame([row], schema)
    got = frame.select(*[tx.stringify(c, frame.schema[c].dataType).alias(c) for c in frame.columns]).first()
    assert tuple(got) == ("p q  r ", "True", "3.0", "")


def test_numbers_print_as_in_scripts(spark):
    values = [0.0, -0.0, 1.0, 12345678.0, -12345678.25, 1e-4, 0.00012, 1e-5, -1.5e-7, 1e7, 123456789012345.6, 1e15, 1e16, 1.5e22, 3e300]
    values += [0.001, 0.5, -2.5e-4, float("nan"), float("inf"), float("-inf"), 1e100, 9007199254740993.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in frame.select("i", tx.stringify("v", T.DoubleType()).alias("t")).orderBy("i").collect()]
    assert got == [str(v) for v in values]


def test_flatten_paths(spark):
    paths = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType().add("c", paths).add("s", T.StringType())
    frame = spark.createDataFrame([([["A ", "B"], [], [None], ["  C"]], " x  y "), (None, None)], schema)
    got = frame.select(tx.flatten_paths("c", paths).alias("c"), tx.flatten_paths("s", T.StringType()).alias("s")).collect()
    assert [tuple(r) for r in got] == [(["A B", "C"], ["x y"]), ([], [])]


@pytest.mark.parametrize(
    "features, budget, expected",
    [
        (["cde", "fgh"], 18, "ab. Features: cde"),
        (["cde", "fgh"], 17, "ab. Features: "),
        (["cde", "fgh"], 22, "ab. Features: cde fgh"),
        (["cde", "fgh"], 21, "ab. Features: cde"),
        (["cdefghij", "k"], 20, "ab. Features: "),
        ([], 100, "ab"),
    ],
)
def test_product_text_budget(spark, features, budget, expected):
    text = tx.product_text("n", "f", F.lit(True), budget)
    assert one(spark, "n string, f array<string>", ("ab", features), text) == expected


def test_product_text_against_plain_loop(spark):
    rng = random.Random(3)
    rows = [("n" * rng.randrange(9), ["x" * rng.randrange(1, 9) for _ in range(rng.randrange(7))], rng.random() < 0.8) for _ in range(300)]
    frame = spark.createDataFrame(rows, "n string, f array<string>, i boolean")
    for r in frame.select("*", tx.product_text("n", "f", "i", 40).alias("x")).collect():
        expected = r.n
        if r.i and r.f:
            left, kept = 40 - len(r.n) - 12, []
            for feature in r.f:
                if left - len(feature) <= 0:
                    break
                kept.append(feature)
                left -= len(feature) + 1
            expected = f"{r.n}. Features: {' '.join(kept)}"
        assert r.x == expected


def test_names_and_features(spark):
    frame = spark.createDataFrame([("", "b", "b", "c"), ("", "", "", "")], "t string, p string, q string, r string")
    got = frame.select(
        tx.product_name([F.col("t"), F.col("p")]).alias("n"),
        tx.product_features([F.col("r"), F.col("p"), F.col("q"), F.col("r")]).alias("f"),
    ).collect()
    assert [(r.n, r.f) for r in got] == [("b", ["c", "b"]), ("Unknown product", [])]


@pytest.mark.parametrize(
    "text, size, top, fallback, expected",
    [
        ("x3,200", 4, 99, [7], [3, 99, 7, 1]),
        ("no digits", 3, 99, None, [1, 1, 1]),
        ("0 5 -6 7", 3, 99, [9], [1, 5, 6]),
        ("9" * 60 + " <|CODE_5|>", 2, 50, None, [50, 5]),
        ("٣ and 007", 3, 99, [0], [3, 7, 1]),
        ("1 2", 4, 99, [500], [1, 2, 99, 1]),
    ],
)
def test_parse_ids(spark, text, size, top, fallback, expected):
    column = tx.parse_ids("t", size, top, "f")
    assert one(spark, "t string, f array<int>", (text, fallback), column) == expected


def test_code_rendering(spark):
    row = ([0, 12, -1],)
    assert one(spark, "c array<int>", row, tx.format_ids("c")) == "<|bos_semantic|>0,12,-1<|eos_semantic|>"
    assert one(spark, "c array<int>", row, tx.code_tokens("c")) == ["<|CODE_0|>", "<|CODE_12|>", None]
    assert one(spark, "c array<int>", ([7, 9, 8, 7],), tx.lookup_codes("c", [9, 7], 3)) == [1, 0, -1]


def test_lookup_of_tokens_that_lie_far_apart(spark):
    known = [5, 10**12, -3, 2**40, 5, 0]
    rows = [[10**12, -3, 5, 9], [0, None, 2**40], [], None, [4, 10**12 + 1, -4]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<bigint>")
    got = {r.i: r.ids for r in frame.select("i", tx.lookup_codes("c", known, 3).alias("ids")).collect()}
    assert got == {0: [1, 2, 4], 1: [5, -1, 3], 2: [], 3: None, 4: [-1, -1, -1]}
    assert one(spark, "c array<int>", ([7],), tx.lookup_codes("c", [], 3)) == [-1]


def test_prompts(spark):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(11)], "i int, t string")
    rows = frame.select(
        "i", "t", guessing_prompt("t", "i", 3, 9).alias("g"), reconstruction_prompt("t", 3, 9).alias("r"),
    ).withColumn("open", without_answer("g")).orderBy("i").collect()
    for r in rows:
        assert [x.role for x in r.g] == [x.role for x in r.r] == ["system", "user", "assistant"]
        assert r.g[1].content == TEMPLATES[r.i % 5].format(product_text=r.t)
        assert r.g[0].content.endswith("placed between <|bos_semantic|> and <|eos_semantic|>.")
        assert "are 3 integers" in r.g[0].content and "to <|CODE_9|>," in r.g[0].content
        assert r.g[2].content == "The semantic-IDs are: <|bos_semantic|>" + "<|eos_semantic|>" * 4
        assert r.r[1].content == r.g[2].content + ". Recover the product name and/or its metadata."
        assert r.r[2].content == f"The product name and/or its metadata are: {r.t}"
        assert r.open == r.g[:2]
