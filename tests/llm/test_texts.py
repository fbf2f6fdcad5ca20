"""SimHash classes, rules, passages, packing and pieces against brute force over whole small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import divergence, factorization, packing, sentences, simhash
from tesserae.llm.components import connect
from tesserae.llm.substrings import COVERS, Repeats
from tesserae.llm.words import Words, window_starts, windows
from tesserae.workspace import store
from tests.llm.cases import SCHEMA, frame, sent, texts

WORD = r"[^\x20\x09-\x0D]+"
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return re.findall(WORD, text or "")


def test_words_are_the_runs_of_the_pattern():
    import pyarrow as pa

    column = pa.array([t for _, t, _ in texts()] + ["é\u0085z \x1c q", "x"])
    for part in (column, column.slice(5, 9), column.slice(len(column) - 1)):
        found = Words(part)
        want = [words(t) for t in part.to_pylist()]
        flat = [w.encode() for own in want for w in own]
        assert [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends)] == flat
        assert found.counts.tolist() == [len(own) for own in want]
        keys = found.keys()
        assert len(set(zip(flat, keys))) == len(set(flat)) == len(set(keys))
        starts = window_starts(found.first, 3)
        grams = [tuple(flat[i : i + 3]) for i in starts]
        assert len(grams) == sum(max(0, len(own) - 2) for own in want)
        assert len(set(zip(grams, windows(keys, 3, 0, starts)))) == len(set(grams))


def fingerprint(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = words(w)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, links):
    """The smallest reachable node of each node."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [64, 0])
def test_simhash_classes(spark, hot):
    rows = texts()
    got = simhash.near_duplicates(frame(spark), hot_bucket=hot).collect()
    marks = [(i, fingerprint(t)) for i, t, _ in rows]
    distinct = sorted({f for _, f in marks})
    near = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    group = classes(distinct, near)
    least = {}
    for i, f in marks:
        if i is not None:
            least[group[f]] = min(least.get(group[f], i), i)
    want = Counter((i, f"{f:016x}", least.get(group[f])) for i, f in marks)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("segments", "hot"), [(2, 1000), (2, 3), (2, 0), (4, 1000), (3, 1000)])
def test_links_connect_what_all_pairs_connect(spark, segments, hot):
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 12)
    marks = set()
    for c in centres:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            marks.add(int(c) ^ int(sum((1 << int(b)) if b < 63 else -(1 << 63) for b in flips)))
    marks |= {0, -1, 1, 3, 7, 15}
    nodes = spark.createDataFrame([(m,) for m in marks], "fp bigint")
    found = [(r.a, r.b) for r in simhash.links(nodes, 3, segments, hot).collect()]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(0 < apart(a, b) <= 3 for a, b in found)
    near = [(a, b) for a in marks for b in marks if a < b and apart(a, b) <= 3]
    assert classes(marks, found) == classes(marks, near)
    if hot >= 1000:
        assert {tuple(sorted(p)) for p in found} == set(near)


@pytest.mark.parametrize("hot", [64, 0])
def test_links_send_no_exploded_rows(spark, hot):
    """Spark sizes probes and ball points as the stored fingerprints; at a million of them they overflow the driver."""
    nodes = store(spark.range(200).select(F.xxhash64("id").alias("fp")).union(spark.range(40).toDF("fp")))
    found = simhash.links(nodes, hot_bucket=hot)
    assert sent(found) and not [x for x in sent(found) if "Generate" in x]
    found.collect()
    assert not [x for x in sent(found) if "Generate" in x]


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200, 260)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    odd = [(5, 5), (7, 6), (6, 7)]
    frame_ = spark.createDataFrame(path + star + odd, "a bigint, b bigint")
    got = {r.node: r.root for r in connect(frame_).collect()}
    want = {i: 200 for i in range(200, 261)} | {1000 + i: 1000 for i in range(80)} | {6: 6, 7: 6}
    assert got == want
    assert connect(frame_.filter("false")).count() == 0


def base_counts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    twice = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    n_symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(twice)


def test_rules_against_plain_counts(spark):
    rows = texts() + [(200, "a b c a b c\nx y\nx y\n\n# $5 <b>", "zz"), (201, "la la la " * 40, "xx")]
    got = divergence.judge(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = Counter((r.doc_id, *(r[n] for n in names), r.base_failed) for r in got)
    want = Counter()
    for i, t, _ in rows:
        counts = base_counts(t)
        want[(i, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])] += 1
    assert found == want
    assert all(not r.kept for r in got if r.base_failed)
    assert divergence.judge(frame(spark, [])).count() == 0


def jensen_shannon(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt((part(p) + part(q)) / 2)


def test_distances_from_the_language_reference(spark):
    rows = [(i, f"the the the the cat cat cat on on mat number{i} " * 12, "xx") for i in range(20)]
    rows += [(100, "THE!! CAT!! SAT!! " * 40, "xx"), (101, "der hund %%% ### " * 30, "rare"), (102, "x", "xx")]
    limits = divergence.Limits(common=3, least_docs=5, languages=1)
    got = {r.doc_id: r for r in divergence.judge(frame(spark, rows), limits=limits).collect()}
    for lang, own in (("xx", [r for r in rows if r[2] == "xx"]), ("rare", rows)):
        counts = Counter(w for _, t, _ in own for w in words(t))
        common = [w for w, n in counts.items() if n >= sorted(counts.values())[-3]]
        assert len(common) == 3
        reference = [counts[w] for w in common] + [sum(counts.values()) - sum(counts[w] for w in common)]
        for i, t, _ in [r for r in rows if r[2] == lang]:
            w = Counter(words(t))
            have = [w[c] for c in common]
            expected = jensen_shannon([*have, sum(w.values()) - sum(have)], reference)
            assert got[i].word_distance == pytest.approx(expected, abs=1e-9)
    assert got[100].class_distance > 0.3 and not got[100].kept
    kept = divergence.passing(frame(spark, rows), limits=limits)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("n", [20, 99, 101])
def test_rare_languages_meet_their_own_reference(spark, n):
    import random

    rng = random.Random(1)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(150)]
    latin, other = make("abcdefghij"), make("абвгдежзик")
    text = lambda own: " ".join(rng.choices(own, k=120))
    rows = [(i, text(latin), "en") for i in range(300)] + [(1000 + i, text(other), "ru") for i in range(n)]
    rows += [(2000, text(other), None), (2001, text(other), "single")]
    rows += [(3000, " ".join(f"{w.upper()}%%{i}!!!!" for i, w in enumerate(rng.choices(latin, k=120))), "ru")]
    for limits in (divergence.Limits(), divergence.Limits(languages=1)):
        got = {r.doc_id: r for r in divergence.judge(frame(spark, rows), limits=limits).collect()}
        assert {i for i, r in got.items() if not r.kept} == {3000}
        kept = divergence.passing(frame(spark, rows), limits=limits)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got) - {3000})
        assert got[1000].class_distance < limits.class_distance and got[2001].class_distance == pytest.approx(0, abs=1e-6)


def removed(rows, width):
    """Kept words of each row, by comparing every window with all windows of smaller ids."""
    order = lambda i: math.inf if i is None else i
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, math.inf), order(i))
    for i, t, _ in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < order(i):
                gone.update(range(p, p + width))
        yield i, t, [x for p, x in enumerate(w) if p not in gone], len(w)


@pytest.mark.parametrize(("width", "period"), [(50, 31), (20, 13), (10, 7)])
def test_passages(spark, width, period):
    docs = frame(spark)
    found = Repeats(docs, width=width, period=period)
    want = Counter()
    new = Counter()
    for i, t, kept, n in removed(texts(), width):
        want[(i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
        new[(i, t if len(kept) == n else " ".join(kept))] += 1
    assert any(k[2] for k in want) and Counter(map(tuple, found.judged().collect())) == want
    rewritten = found.rewritten(docs)
    assert rewritten.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in rewritten.select("doc_id", "text").collect()) == new
    assert Repeats(frame(spark, [])).judged().count() == 0


def test_covers_have_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_pieces_and_packing(spark):
    rows = texts() + [(300, "a <|endoftext|> b", "xx"), (301, "two  spaces\n and 日本 \U0001f642", "xx"), (302, " lead", "xx")]
    found = packing.pieces(frame(spark, rows), BPE, with_ids=True)
    tokenizer = Tokenizer.from_file(BPE)
    want = Counter()
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    assert Counter((*r[:5], tuple(r.ids)) for r in found.collect()) == want
    for group in (10**6, 16):
        packed = packing.pack(found.drop("ids"), group_items=group).collect()
        assert Counter(tuple(r)[:5] for r in packed) == Counter({k[:5]: 0 for k in want} | Counter(k[:5] for k in want.elements()))
        places = {}
        for r in packed:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r.length for r in packed)
        assert len(places) <= math.ceil(total / 1024) + 4
    assert packing.pack(packing.pieces(frame(spark, []), BPE)).count() == 0


@pytest.mark.parametrize("n, most", [(1000, 1.01), (40, 1.15), (3, 1.0), (1, 1.0)])
def test_small_tables_go_through_all_rounds(spark, monkeypatch, n, most):
    """The rounds cost at most one sequence in a hundred against one best-fit run of a thousand pieces."""
    rng = np.random.default_rng(n)
    sizes = np.minimum(1024, np.maximum(1, rng.lognormal(5, 1.3, n).astype(int)))
    rounds, real = [], packing.packed
    monkeypatch.setattr(packing, "packed", lambda *a: rounds.append((a[3], a[5])) or real(*a))
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id int, length int").repartition(3)
    got = packing.pack(items).collect()
    assert [s for s, _ in rounds] == [4, 32, None] and rounds[0][1] == max(1, -(-int((sizes < 1024).sum()) // 8))
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert len(got) == n and max(fills.values()) <= 1024
    loose = sizes[sizes < 1024]
    one = len(packing.best_fit(loose, 1024, None)[2]) + int((sizes == 1024).sum())
    assert len(fills) <= most * one


def test_packing_keeps_columns_of_any_name(spark):
    odd = "bin next more shift fill room item _bin _shift _fill _next _more offset sequence_id".split()
    items = spark.createDataFrame([(i, 300) for i in range(20)], "id int, length int")
    items = items.selectExpr("*", *[f"concat('{c}', id) AS `{c}`" for c in odd])
    for row in packing.pack(items, group_items=3).collect():
        assert all(row[c] == f"{c}{row.id}" for c in odd[:-2]) and row.offset in (0, 300, 600)


def test_flat_vocabularies_have_common_words(spark):
    """Without a word that is more frequent than one in a thousand, the 64 commonest still judge."""
    rows = [(i, " ".join(f"w{j}" for j in range(2000)), "xx") for i in range(3)]
    rows += [(10, " ".join(f"w{j % 64}" for j in range(200)), "xx")]
    known, _ = divergence.references(spark.createDataFrame(rows, "id int, text string, lang string").select("lang", "text"), divergence.Limits())
    _, total, keys, counts = known["xx"]
    assert total == 6200 and len(keys) == 64 and sorted(set(counts)) == [6.0, 7.0]


def test_clashing_columns_beside_joined_references(spark):
    rows = [(i, "a b c " * 30, lang) for i, lang in enumerate(["xx", "yy", "zz", None] * 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    odd = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in ("_reference_of", divergence.REFERENCE, "__reference_of")])
    limits = divergence.Limits(languages=1)
    got = divergence.passing(odd, limits=limits)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in divergence.passing(docs, limits=limits).collect())


def test_a_sampled_id_counts_once(spark):
    rng = random.Random(1)
    word = lambda label: rng.choice(("good", "fine", "well") if label else ("bad", "worse", "junk"))
    docs = [(i, " ".join(word(i % 2) for _ in range(30)), 100) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, quality int")
    plain = spark.createDataFrame(docs, "doc_id int, text string, n_chars int")
    many = plain.unionByName(spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(docs[1][1]).alias("text"), F.lit(100).alias("n_chars")))
    named = labels.withColumnRenamed("quality", "label")
    settings = factorization.Settings()
    one, other = (factorization.learn(factorization.table_of(d, "doc_id", "text", "n_chars"), named, settings) for d in (plain, many))
    assert one.bias == other.bias and np.array_equal(one.weights, other.weights)


def test_passages_refuse_text_ids(spark):
    with pytest.raises(ValueError, match="integers"):
        Repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_best_fit_rounds_in_many_groups(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 700, 3000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "i int, length bigint").repartition(6)
    bins = {}
    for group in (10**6, 300):
        got = packing.pack(items, group_items=group).collect()
        fills = Counter()
        for r in got:
            fills[r.sequence_id] += r.length
        assert sorted(r.i for r in got) == list(range(3000)) and max(fills.values()) <= 1024
        bins[group] = len(fills)
    least = math.ceil(sizes.sum() / 1024)
    assert bins[10**6] <= 1.01 * least and bins[300] <= 1.03 * least


def test_pieces_of_sentences(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = texts() + [(300, " lead  two ▁ x", "xx"), (301, "日本 \U0001f642<s>\x00\n", "xx")]
    docs = frame(spark, rows)
    encoded = sentences.encode(docs, PIECE)
    want = Counter((i, tuple(library.encode(t or ""))) for i, t, _ in rows)
    got = encoded.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    by_ids = {tuple(library.encode(t or "")): (t or "").encode() for _, t, _ in rows}
    for r in got:
        source = by_ids[tuple(r.ids)]
        assert r.starts[1:] == r.ends[:-1] and (not r.ids or (r.starts[0], r.ends[-1]) == (0, len(source)))
        for i, a, b in zip(r.ids, r.starts, r.ends):
            piece = library.id_to_piece(i)
            plain = piece.replace("▁", " ").encode()
            if not library.is_byte(i) and "▁".encode() not in source:
                assert source[a:b] in (plain, plain[1:])
    digests = sentences.encode(docs, PIECE, digests=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = Counter((i, sha(",".join(map(str, library.encode(t or "")))), sha(library.decode(library.encode(t or "")))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in digests) == plain
    decoded = sentences.decode(encoded, PIECE)
    assert Counter(r.text for r in decoded.collect()) == Counter(library.decode(library.encode(t or "")) for _, t, _ in rows)
    assert sentences.encode(frame(spark, []), PIECE).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_normalisation_equals_the_library(rule, trim):
    import random

    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim
    )
    rules = next(dict(sentences.fields(v)) for n, v in sentences.fields(library.serialized_model_proto()) if n == 3)
    model = sentences.Model.__new__(sentences.Model)
    model.map, model.suffix = sentences.CharacterMap(rules.get(2, b"")), False
    model.dummy_prefix, model.trim, model.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    rng = random.Random(4)
    pool = "aA ﬁ①½ﷺ 　 é가ﾊﾟ​\x07\U0001f642ß▁İ\t\n"
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        normal, places = model.normalized(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert normal.decode() == want and len(places) == len(normal) + 1
        byte_of = [len(text[:i].encode()) for i in range(len(text) + 1)]
        starts = [len(want[:i].encode()) for i in range(len(want) + 1)]
        assert [int(places[s]) for s in starts] == [byte_of[o] for o in offsets]


def test_machine_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = factorization.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=(5, 9)) * (rng.random((5, 9)) < 0.5)
    rows, columns = np.nonzero(x)
    got = machine.scores(rows, columns, x[rows, columns], 5)
    for i in range(5):
        pairs = sum(machine.factors[a] @ machine.factors[b] * x[i, a] * x[i, b] for a in range(9) for b in range(a))
        assert got[i] == pytest.approx(0.3 + machine.weights @ x[i] + pairs)


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = factorization.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.97 and all(r.predicted == (r.score >= 0.3) for r in got)
    kept = {r.doc_id for r in factorization.passing(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in factorization.score(docs, labels).filter("predicted = 1").collect()}


def test_quality_of_odd_rows_and_few_labels(spark):
    docs = frame(spark).withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.length("text")))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in factorization.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id bigint, quality int")
    got = factorization.score(docs, one).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    some = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    got = factorization.score(docs, some).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in got)
    assert factorization.score(docs.filter("false"), some).count() == 0
    assert spark.createDataFrame([], SCHEMA).count() == 0
