"""Ids and texts against the tokenizers library, piece by piece and over whole tables."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import prefix_bpe as P
from tests.llm.cases import frame, texts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = "a b th er ing A The 1 23 's 'll ' -- ... _ # é ß ñ ² ½ ſ İ ɐ Ⅷ 中 文 😀 <|endoftext|> <|end |>".split()
PARTS += [" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "\x00", "​", "﻿", "́", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    with open(FILE, "rb") as file:
        return P.PrefixSharing(file.read())


def test_random_texts(library, coder):
    rng = random.Random(4)
    rows = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    rows += ["a" * 20_000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), " " * 5000 + "x", "中文" * 3000, "", " ", "\n"]
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [i.tolist() for i in coder.encode(rows)] == want
    assert [coder.decode(i) for i in want] == rows


def test_every_character_of_the_first_planes(library, coder):
    rows = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1'{chr(c)}s" for c in range(0x3100)]
    assert [i.tolist() for i in coder.encode(rows)] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_decoding_any_ids(library, coder):
    rng = random.Random(8)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_trie_keeps_words_and_splits_labels(coder):
    words = [b"walk", b"walking", b"walked", b"wall", b"w", b"talk", "é".encode(), b"walk"]
    root = P.Node(b"", False)
    for word in words:
        P.insert(root, word)
    found = []

    def visit(node, path):
        if node.ends:
            found.append(path + node.label)
        for first, child in (node.children or {}).items():
            assert child.label[0] == first
            visit(child, path + node.label)

    visit(root, b"")
    assert sorted(found) == sorted(set(words))
    assert {w: np.frombuffer(i, "<i4").tolist() for w, i in coder.encode_pieces(words).items()} == {w: coder.merged(w) for w in set(words)}


def test_shared_prefixes_are_encoded_once(coder, monkeypatch):
    calls = []
    real = P.PrefixSharing.last_token
    monkeypatch.setattr(P.PrefixSharing, "last_token", lambda self, *a: calls.append(a) or real(self, *a))
    coder.encode_pieces([b"international", b"internationally", b"internal", b"interval"])
    assert len(calls) == len("internationally") + len("l") + len("val")


def test_pairs_stay_apart_as_merging_says(coder):
    rng = random.Random(3)
    tokens = sorted(coder.ids.values())
    for _ in range(60_000):
        a, b = rng.choice(tokens[: rng.choice((300, 3000, 50_000))]), rng.choice(tokens[: rng.choice((300, 3000, 50_000))])
        assert coder.fits(a, b) == (coder.merged(coder.tokens[a] + coder.tokens[b]) == [a, b]), (a, b)


def test_table_equals_library(spark, library):
    rows = texts() + [(500, "x<|endoftext|> y", "xx"), (501, "名前 ©", "yy")]
    found = {}
    for r in P.encode(frame(spark, rows), FILE).collect():
        found.setdefault(r.doc_id, []).append(r.ids)
    want = {}
    for doc_id, text, _ in rows:
        want.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    digests = P.encode(frame(spark, rows), FILE, digests=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {(r, sha(",".join(map(str, i)))) for r, group in want.items() for i in group}
    assert {(r.doc_id, r.ids_sha256) for r in digests} == ids
    assert {(r.doc_id, r.decoded_sha256) for r in digests} == {(d, sha(t or "")) for d, t, _ in rows}
    back = P.decode(P.encode(frame(spark, rows), FILE), FILE).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)


def test_empty_table_and_null_ids(spark):
    assert P.encode(frame(spark, []), FILE, digests=True).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.text for r in P.decode(rows, FILE).collect()] == ["", ""]


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        content = file.read()
    with pytest.raises(ValueError):
        P.PrefixSharing(content)
    described = json.loads(open(FILE).read())
    described["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        P.PrefixSharing(json.dumps(described).encode())
