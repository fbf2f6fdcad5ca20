import gzip
import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import items as im
from tesserae.operators.interactions import chunked
from tesserae.plans import corpus
from tesserae.plans.preprocess import preprocess_files
from tesserae.sinks import artifacts as snk
from tesserae.sources import artifacts as art
from tesserae.sources import texts

CATEGORIES = ["Beauty", "Toys & Games"]


def make_files(folder):
    """Reviews and metadata of two categories sharing user names; returns the raw rows."""
    rng = random.Random(11)
    reviews, metadata = {}, {}
    for category in CATEGORIES:
        rows = [
            (f"u{int(rng.paretovariate(0.8)) % 50}", f"b{rng.randrange(40):02d}", rng.choice([0.0, 3.0, 5.0]), rng.randrange(50))
            for _ in range(900)
        ]
        reviews[category] = rows
        lines = [str({"reviewerID": u, "asin": i, "overall": r, "unixReviewTime": t}) for u, i, r, t in rows]
        with gzip.open(folder / f"reviews_{category}_5.json.gz", "wt") as handle:
            handle.write("\n".join(lines + ["broken {"]))
        items = [f"b{i:02d}" for i in range(50)] * 2
        rng.shuffle(items)
        metadata[category] = [
            {
                "asin": a,
                "title": rng.choice(["", f" Item  {a} "]),
                "description": "some text",
                "categories": [["Root", rng.choice(["L1", "L2"])], ["Root"], ["Root", "L1", f"S{rng.randrange(5)}"]][: rng.randrange(4)],
                **rng.choice([{}, {"brand": ""}, {"brand": None}, {"brand": f"B{rng.randrange(6)}"}]),
            }
            for a in items
            if a not in ("b03", "b07")
        ]
        with gzip.open(folder / f"meta_{category}.json.gz", "wt") as handle:
            handle.write("\n".join(map(str, metadata[category])))
    return reviews, metadata


def plain_core(rows, floor=0.0, core=5):
    kept = [(u, i, t, n) for n, (u, i, r, t) in enumerate(rows) if r > floor]
    while True:
        users, items = Counter(r[0] for r in kept), Counter(r[1] for r in kept)
        left = [r for r in kept if users[r[0]] >= core and items[r[1]] >= core]
        if len(left) == len(kept):
            return kept
        kept = left


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    reviews, metadata = make_files(folder)
    out = str(tmp_path_factory.mktemp("out") / "artifacts")
    result = preprocess_files(spark, CATEGORIES, str(folder), out, negatives=9)
    return reviews, metadata, folder, out, result


def read_maps(out, category):
    """The single chunk of the id maps, as a JSON reader without Spark sees it."""
    from pathlib import Path

    [folder] = [p for p in Path(out, "datamaps").iterdir() if p.name.replace("%20", " ") == f"category={category}"]
    lines = [line for part in folder.rglob("part-*.txt") for line in part.read_text().splitlines()]
    assert len(lines) == 1
    return json.loads(lines[0])


def test_artifacts_against_plain_python(spark, run):
    reviews, metadata, _, out, result = run
    sequences = defaultdict(dict)
    for r in art.read_sequences(spark, out, CATEGORIES).collect():
        sequences[r.category][r.user_id] = r.item_ids
    negatives = {(r.category, r.user_id): r.neg_items for r in art.read_negatives(spark, out, CATEGORIES).collect()}
    attributes = {(r.category, r.item_id): r.attribute_ids for r in art.read_item_attributes(spark, out, CATEGORIES).collect()}
    stats = {r.category: r for r in result.stats.collect()}
    for category in CATEGORIES:
        kept = plain_core(reviews[category])
        maps = read_maps(out, category)
        by_user = defaultdict(list)
        for u, i, t, _ in sorted(kept, key=lambda r: (r[2], r[3])):
            by_user[u].append(i)
        assert maps["user2id"] == {u: n for n, u in maps["id2user"].items()} and set(maps["user2id"]) == set(by_user)
        assert maps["item2id"] == {i: n for n, i in maps["id2item"].items()}
        walked = {}
        for n in range(1, len(by_user) + 1):
            own = by_user[maps["id2user"][str(n)]]
            assert sequences[category][str(n)] == [maps["item2id"][i] for i in own]
            for i in own:
                walked.setdefault(i, str(len(walked) + 1))
            unseen = set(maps["id2item"]) - {maps["item2id"][i] for i in own}
            picked = negatives.get((category, str(n)), [])
            assert len(picked) == len(set(picked)) == min(9, len(unseen)) and set(picked) <= unseen
        assert walked == maps["item2id"]
        last = {}
        for record in metadata[category]:
            if record["asin"] in walked:
                last[record["asin"]] = record
        names, counts = {}, Counter()
        for asin, record in last.items():
            labels = ([record["brand"]] if record.get("brand") else []) + [x for p in record["categories"] for x in p[1:]]
            for label in labels:
                names.setdefault(label, len(names) + 1)
                counts[str(names[label])] += 1
            assert attributes.pop((category, int(maps["item2id"][asin]))) == [names[x] for x in labels]
        assert maps["attribute2id"] == names and maps["attributeid2num"] == dict(counts)
        assert maps["id2attribute"] == {str(n): a for a, n in names.items()}
        row = stats[category]
        assert (row.users, row.items, row.interactions) == (len(by_user), len(walked), len(kept))
        assert row.sparsity == pytest.approx((1 - len(kept) / (len(by_user) * len(walked))) * 100)
    assert not attributes


def test_chunked_artifacts_read_back_whole(spark, run, tmp_path):
    _, _, _, out, result = run
    root = str(tmp_path / "chunks")
    snk.write_sequences(result.encoded, root, chunk=3)
    snk.write_id_maps(result.users, result.items, result.attributes, root, chunk=4)
    rows = art.read_sequences(spark, root, CATEGORIES)
    assert rows.agg(F.max("chunk_no")).first()[0] > 2
    whole = defaultdict(list)
    for r in rows.orderBy("chunk_no").collect():
        whole[r.category, r.user_id] += r.item_ids
    expected = {(r.category, r.user_id): r.item_ids for r in art.read_sequences(spark, out, CATEGORIES).collect()}
    assert whole == expected
    same = [sorted(tuple(r) for r in art.read_item_ids(spark, p, CATEGORIES).collect()) for p in (root, out)]
    assert same[0] == same[1]


def test_item_corpus(spark, run):
    _, metadata, folder, out, _ = run
    config = {
        "dataset_version": "2014", "categories": CATEGORIES, "metadata_dir": str(folder), "sequential_dir": out,
        "eval_split_ratio": 0.1, "max_num_chars": 40, "codebook_size": 4, "codebook_range": 32,
    }
    records = corpus.load_corpus(spark, config).collect()
    allowed = {c: set(read_maps(out, c)["item2id"]) for c in CATEGORIES}
    expected = sum(r["asin"] in allowed[c] for c in CATEGORIES for r in metadata[c])
    assert len(records) == expected
    evals = [r for r in records if r.split == "eval"]
    assert sorted(r["index"] for r in evals) == list(range(math.ceil(0.1 * expected)))
    for r in records:
        assert r.product_name == (r.title or "Unknown product")
        assert r.reconstruction_prompt[2].content.endswith(": " + r.product_text)
        assert r.guessing_prompt[2].content.count("<|eos_semantic|>") == 5
    assert {r.product_text.startswith(r.product_name + ". Features: ") for r in records} == {True, False}
    free = corpus.item_corpus(spark, {**config, "restrict_to_datamaps": False})
    assert free.count() == sum(map(len, metadata.values()))
    with pytest.raises(ValueError, match="needs sequential_dir"):
        corpus.item_corpus(spark, {**config, "sequential_dir": None, "restrict_to_datamaps": True})
    by_category = corpus.prompt_records(corpus.item_corpus(spark, config), corpus.Settings.of(config), by_category=True)
    sizes = {(r.category, r.split): r["count"] for r in by_category.groupBy("category", "split").count().collect()}
    for c in CATEGORIES:
        total = sizes[c, "eval"] + sizes[c, "train"]
        assert sizes[c, "eval"] == math.ceil(0.1 * total)


def test_sequence_corpus(spark, run):
    _, _, _, out, _ = run
    config = {"dataset_mode": "sequential", "sequential_dir": out, "categories": CATEGORIES, "eval_split_ratio": 0.2}
    records = corpus.load_corpus(spark, config).collect()
    users = art.read_sequences(spark, out, CATEGORIES).count()
    assert len(records) == users and sum(r.split == "eval" for r in records) == int(users * 0.2)
    assert all(len(r.neg_items) <= 9 for r in records)
    with pytest.raises(ValueError, match="needs sequential_dir"):
        corpus.load_corpus(spark, {**config, "sequential_dir": None})


def test_plain_file_layout(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "B").mkdir()
    (tmp_path / "A" / "sequential_data.txt").write_text("1 5 6\n2\n\n  3  4 \n1 7 8 9\n")
    (tmp_path / "B" / "sequential_data.txt").write_text("1 5\n")
    (tmp_path / "A" / "negative_samples.txt").write_text("1 2 3\n")
    (tmp_path / "A" / "datamaps.json").write_text(json.dumps({"item2id": {"x": "1", "y": "2"}, "user2id": {"u": "1"}}))
    config = {
        "dataset_mode": "sequential", "sequential_dir": str(tmp_path), "categories": ["A", "B"],
        "partitioned_artifacts": False,
    }
    got = {(r.category, r.user_id): (r.item_ids, r.neg_items) for r in corpus.load_corpus(spark, config).collect()}
    assert got == {("A", "1"): (["7", "8", "9"], ["2", "3"]), ("A", "3"): (["", "4"], []), ("B", "1"): (["5"], [])}
    ids = art.read_item_ids(spark, str(tmp_path), ["A"], partitioned=False)
    assert sorted((r.item, r.item_id) for r in ids.collect()) == [("x", 1), ("y", 2)]
    with pytest.raises(FileNotFoundError, match="datamaps of 'B' not found"):
        art.read_item_ids(spark, str(tmp_path), ["B"], partitioned=False)
    with pytest.raises(FileNotFoundError, match="sequential_data of 'C' not found"):
        corpus.load_corpus(spark, {**config, "categories": ["C"]})


def test_structured_products(spark, tmp_path):
    lines = [
        {"title": "", "name": "N", "features": ["f", " f2"], "description": [], "categories": ["a", "b"], "more": 1},
        {"title": " T ", "features": ["same"], "description": ["same"], "details": None},
        {},
    ]
    path = tmp_path / "meta.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    config = {"category": "x", "product_paths": {"x": str(path)}, "feature_probability": 1.0}
    got = {r.product_name: r.product_features for r in corpus.load_corpus(spark, config).collect()}
    assert got == {"N": ["f f2", "a b"], "T": ["same"], "Unknown product": []}


def test_text_inputs(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("  first \n\n   \nsecond\n")
    rows = texts.read_texts(spark, [" arg ", " "], str(path)).orderBy("index").collect()
    assert [tuple(r) for r in rows] == [(0, " arg "), (1, "first"), (2, "second")]
    assert texts.read_texts(spark, ["a", "b"], max_samples=1).count() == 1
    assert texts.read_texts(spark, ["a", "b"], max_samples=0).count() == 0


def test_last_record_wins_but_first_gives_the_order(spark):
    rows = [("c", 1, "a", "old"), ("c", 2, "b", "b"), ("c", 3, "a", "new"), ("c", 4, "z", "z")]
    frame = spark.createDataFrame(rows, "category string, seq bigint, asin string, title string")
    allowed = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "z")], "category string, item string")
    got = sorted(tuple(r) for r in im.latest(frame, allowed).collect())
    assert got == [("c", "a", 1, "new"), ("c", "b", 2, "b")]


def test_chunks_of_a_long_key(spark):
    frame = spark.range(1, 10_001).select(F.lit("k").alias("k"), F.col("id").alias("pos"), (-F.col("id")).alias("v"))
    rows = chunked(frame, ["k"], "pos", "v", "vs", chunk=999).orderBy("chunk_no").collect()
    assert [len(r.vs) for r in rows] == [999] * 10 + [10]
    assert [v for r in rows for v in r.vs] == [-i for i in range(1, 10_001)]


def test_many_chunks_of_maps_lie_in_few_folders(spark, tmp_path):
    ids = spark.range(1, 1001)
    users = ids.select(F.lit("c").alias("category"), F.concat(F.lit("u"), "id").alias("user"), F.col("id").alias("user_id"))
    items = ids.select(F.lit("c").alias("category"), F.concat(F.lit("i"), "id").alias("item"), F.col("id").alias("item_id"))
    names = ids.select(
        F.lit("c").alias("category"), F.concat(F.lit("a"), "id").alias("attribute"), F.col("id").alias("attribute_id"), F.lit(1).alias("num")
    )
    root = str(tmp_path / "maps")
    snk.write_id_maps(users, items, names, root, chunk=3)
    lists = items.select("category", "item_id", F.array("item_id").alias("attribute_ids"))
    snk.write_item_attributes(lists, root, chunk=3)
    for artifact in (art.ID_MAPS, art.ITEM_ATTRIBUTES):
        folders = {p.name for p in (tmp_path / "maps" / artifact / "category=c").iterdir()}
        assert folders == {"chunk_no=0", *(f"chunk_no={2**n}" for n in range(9))}
    assert sorted((r.item, r.item_id) for r in art.read_item_ids(spark, root, ["c"]).collect()) == sorted((f"i{n}", n) for n in range(1, 1001))
    assert sorted((r.item_id, r.attribute_ids) for r in art.read_item_attributes(spark, root, ["c"]).collect()) == [(n, [n]) for n in range(1, 1001)]
    with pytest.raises(ValueError, match="several chunks"):
        snk.to_category_folders(spark, root, str(tmp_path / "out"))
