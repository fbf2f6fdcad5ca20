import ast
import gzip

import pytest
from pyspark.sql import types as T

from tesserae.functions import literals
from tesserae.sources import files, loose

REVIEW = "{'reviewerID': 'u%d', 'asin': 'a', 'overall': %s, 'unixReviewTime': %s}"


def write_gzip(path, lines: list[bytes]) -> str:
    with gzip.open(path, "wb") as handle:
        handle.write(b"\n".join(lines) + b"\n")
    return str(path)


def test_reviews_keep_and_drop_the_right_lines(spark, tmp_path):
    good = [
        (1, "4.0", "10"), (2, "'4'", "11"), (3, "'nan'", "12"), (4, "True", "1.9"), (5, "5", "' 12 '"),
    ]
    bad = [
        (6, "0.0", "1"), (7, "-1", "1"), (8, "None", "1"), (9, "4", "'1.5'"), (10, "4", "None"),
        (11, "[1]", "1"), (12, "'x'", "1"),
    ]
    lines = [(REVIEW % row).encode() for row in good + bad]
    lines += [
        b"", b"   ", b"garbage", b"['not', 'a dict']", b"{'asin': 'a', 'overall': 5.0}",
        b"{'reviewerID': 'u20', 'asin': 'a', 'overall': 5, 'unixReviewTime': 1} trailing",
        b"{'reviewerID': null, 'asin': 'a', 'overall': 5, 'unixReviewTime': 1}",
        b"{'reviewerID': 'u21', 'asin': 'a', 'overall': true, 'unixReviewTime': 1}",
        b"  {'reviewerID': u'u\\xe922', \"asin\": 'a', 'overall': 5, 'unixReviewTime': 7, 'extra': {'k': [1]}}  ",
        b"{'reviewerID': 'u2\xff3', 'asin': 'a', 'overall': 5, 'unixReviewTime': 8}",
        b"{[]: 1}", b"(" * 500,
    ]
    path = write_gzip(tmp_path / "reviews.json.gz", lines)
    rows = loose.read_interactions(spark, {"Beauty": path}).orderBy("seq").collect()
    assert [(r.user, r.ts) for r in rows] == [
        ("u1", 10), ("u2", 11), ("u3", 12), ("u4", 1), ("u5", 12), ("ué22", 7), ("u23", 8),
    ]
    assert {r.category for r in rows} == {"Beauty"}


def test_metadata_types_and_line_order(spark, tmp_path):
    lines = [
        b"{'asin': 'b', 'title': 3, 'description': ['x ', None, 'y'], 'categories': 'Toys', 'brand': ''}",
        b"{'asin': 'a', 'categories': [['Root', 'L1'], 'Flat'], 'brand': None}",
        b"{'asin': 'a', 'categories': []}",
    ] + [b"{'asin': 'n%d'}" % i for i in range(500)]
    path = write_gzip(tmp_path / "meta.json.gz", lines)
    rows = loose.read_metadata(spark, {"c": path}).orderBy("seq").collect()
    assert [r.asin for r in rows] == ["b", "a", "a"] + [f"n{i}" for i in range(500)]
    assert (rows[0].title, rows[0].description, rows[0].categories) == ("3", "x  y", [["Toys"]])
    assert rows[0].brand == "" and rows[1].brand is None
    assert rows[1].categories == [["Root", "L1"], ["Flat"]] and rows[2].categories == []


def test_line_order_of_a_split_file(spark, tmp_path):
    path = tmp_path / "plain.txt"
    path.write_text("".join(f"line {i:06d}\n" for i in range(20_000)))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.read_lines(spark, str(path), "file")
        assert lines.rdd.getNumPartitions() > 4
        values = [r.value for r in lines.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert values == sorted(values) and len(values) == 20_000


def test_missing_file_is_named(spark):
    with pytest.raises(FileNotFoundError, match="reviews of 'Beauty' not found: /nowhere"):
        loose.read_interactions(spark, {"Beauty": "/nowhere/reviews.json.gz"})


@pytest.mark.parametrize("text", [
    "{'a': 1, 'b': -2.5e3, 'c': [0, [1]], 'd': {'e': 'é#'}, 'a': 2}", '{"a": "it\'s", "b": "x\\n\\t\\\\ \\"q\\""}',
    "{'a': 'x\\n\\\\'}", "{'a': 'x\\'y'}", '{"a": "x\\/y"}', "{'a': '\\/'}", '{"a": "\\u00e9"}', "{'a': '\\ud83d\\ude00' }",
    "{'a': true}", "{'a': null}", "{'a': 'true'}", "{'a': True, 'b': None}", "{'a': NaN}", "{'a': -Infinity}", "{'a': 1e999}",
    "{'a': 007}", "{'a': 1_0}", "{'a': 0x1f}", "{'a': -0}", "{'a': 1.}", "{'a': +1}", "{'a': 1,}", "{'a': 'b' 'c'}", "{'a': ''''}", "{'a': ''}",
    "{'a': u'b'}", "{'a': b'b'}", "{'a': 'b\tc'}", "{'a': 1} # 'b'", "{'a': 1}}", "[1]", "3", "'a'", "{}", "{1: 2}", "{'a': '\\x41'}",
    "{'a': %s}" % ("[" * 150 + "]" * 150), "{'a': %s}" % ("[" * 300 + "]" * 300), "{'a': %s}" % ("9" * 5000), "﻿{'a': 1}",
    "{'a': \"b'c\", 'd': 'e'}", "{'a':\r1}", "{'a': 'b\rc'}", "{'a': '\x00'}", "{'a': '\x7f '}",
])
def test_fast_reading_equals_that_of_literals(text):
    try:
        expected = ast.literal_eval(text.strip())
    except literals._BAD_LINE:
        expected = None
    found = literals.parse_literal(text.encode("utf-8", "surrogatepass"))
    assert repr(found) == repr(expected if isinstance(expected, dict) else None)


def test_plain_lines_need_no_python_parser(monkeypatch):
    def refused(text):
        raise AssertionError(f"parsed as Python: {text}")

    monkeypatch.setattr(literals.ast, "literal_eval", refused)
    line = "{'reviewerID': 'u1', 'asin': 'a', 'overall': 5.0, 'helpful': [0, 0], 'unixReviewTime': 7}"
    assert literals.parse_literal(line.encode())["unixReviewTime"] == 7
    assert literals.parse_literal(line.replace("'", '"').replace("u1", "it's").encode())["reviewerID"] == "it's"


@pytest.mark.parametrize("dtype, values", [
    (T.LongType(), [1, None, 2**63 - 1]), (T.LongType(), [1, 2**63]), (T.LongType(), [True, 1.9, "3", "x"]), (T.StringType(), ["a", None, ""]),
    (T.StringType(), ["a", 3]), (T.DoubleType(), [1.5, float("inf")]), (T.DoubleType(), [1.5, 2, "nan"]), (T.ArrayType(T.StringType()), [["a"], "b"]),
])
def test_columns_are_converted_like_single_values(dtype, values):
    assert repr(literals.converted(values, dtype)) == repr([literals.convert(v, dtype) for v in values])
