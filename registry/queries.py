"""One query per operator, each over whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import inputs as inp
from tesserae.functions import text as tx
from tesserae.functions.prompts import guessing_prompt, reference_text, without_answer
from tesserae.operators import attributes as at
from tesserae.operators import baselines as bl
from tesserae.operators import codes as cd
from tesserae.operators import collisions as cl
from tesserae.operators import ids as idm
from tesserae.operators import interactions as it
from tesserae.operators import items as im
from tesserae.operators import negatives as ng
from tesserae.operators import prefixes as px
from tesserae.operators import quantize as qz
from tesserae.operators import recommendation as rm
from tesserae.operators import reconstruction as rc
from tesserae.operators import splits as sp
from tesserae.operators.ranking import positions
from tesserae.plans import comparison, corpus, evaluation
from tesserae.plans.accumulation import CodeCounts
from tesserae.plans.preprocess import preprocess, preprocess_files
from tesserae.sinks import artifacts as snk
from tesserae.sinks import reports
from tesserae.sources import artifacts as art
from tesserae.sources import loose, structured, texts
from tesserae.sources.files import read_lines
from tesserae.workspace import new_path, store

QUERIES = {}

SIZE, RANGE = inp.POSITIONS, inp.CODES


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def joined(name: str, sep: str = " "):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), sep)


# --- interactions ---------------------------------------------------------------------------


@query
def interaction_counts(spark, sf):
    rows = inp.interactions(spark, sf)
    users = it.user_counts(rows).select(F.lit("user").alias("side"), "category", F.col("user").alias("key"), "n")
    items = it.item_counts(rows).select(F.lit("item").alias("side"), "category", F.col("item").alias("key"), "n")
    return users.unionByName(items)


@query
def rating_filter(spark, sf):
    kept = it.rating_filter(inp.purchases(spark, sf))
    return kept.select("category", "user", "item", "ts", "overall", "seq.l_orderkey", "seq.l_linenumber")


@query
def kcore_check(spark, sf):
    rows = inp.interactions(spark, sf)
    return it.is_kcore(rows).withColumn("cores", F.lit("5/5")).unionByName(
        it.is_kcore(rows, 1, 1).withColumn("cores", F.lit("1/1"))
    )


@query
def kcore_pass(spark, sf):
    return it.drop_under_core(inp.interactions(spark, sf), 5, 20).select(
        "category", "user", "item", "ts", "seq.l_orderkey", "seq.l_linenumber"
    )


def core(spark: SparkSession, sf: str, user_core: int = 5, item_core: int = 5) -> DataFrame:
    return it.kcore(store(inp.interactions(spark, sf), "interactions"), user_core, item_core)


@query
def kcore_interactions(spark, sf):
    return core(spark, sf).select("category", "user", "item", "ts", "seq.l_orderkey", "seq.l_linenumber")


def keys_of(rows: DataFrame) -> DataFrame:
    """Stored without what statistics do not need."""
    return store(rows.select("category", "user", "item"), "interactions")


@query
def kcore_stats(spark, sf):
    rows = keys_of(inp.interactions(spark, sf))
    return rounded(it.dataset_stats(it.kcore(rows), rows), "avg_len", "sparsity")


@query
def kcore_many_rounds(spark, sf):
    rows = keys_of(inp.one_category(inp.interactions(spark, sf)))
    return rounded(it.dataset_stats(it.kcore(rows, 20, 20), rows), "avg_len", "sparsity")


@query
def kcore_buckets(spark, sf):
    """The same statistics with the edges cut into many buckets and rewritten after large rounds."""
    rows = keys_of(inp.one_category(inp.interactions(spark, sf)))
    return rounded(it.dataset_stats(it.kcore(rows, 20, 20, bucket_keys=400), rows), "avg_len", "sparsity")


@query
def kcore_empty(spark, sf):
    rows = keys_of(inp.interactions(spark, sf))
    return rounded(it.dataset_stats(it.kcore(rows, 9, 28), rows), "avg_len", "sparsity")


def listed_sequences(rows: DataFrame) -> DataFrame:
    lists = it.chunked(it.sequences(rows), it.USER, "pos", "item", "items")
    return lists.withColumn("items", joined("items"))


@query
def user_sequences(spark, sf):
    return listed_sequences(store(inp.interactions(spark, sf), "interactions"))


@query
def event_sequences(spark, sf):
    return listed_sequences(inp.clicks(spark, sf))


# --- ids ------------------------------------------------------------------------------------


def numbered(rows: DataFrame, within: DataFrame | None = None):
    """(sequenced, users, items, encoded) of an interaction frame, which is part of the stored one named ``within``."""
    placed = it.sequences(store(rows, "interactions") if within is None else rows, within=within)
    sequenced = store(placed.select("category", "user", "item", "pos"), "sequenced")
    users = store(idm.user_ids(sequenced), "user-ids")
    sequenced = store(idm.with_user_ids(sequenced, users), "sequenced")
    items = store(idm.item_ids(sequenced, users), "item-ids")
    return sequenced, users, items, idm.encode(sequenced, users, items)


def numbered_core(spark: SparkSession, sf: str):
    rows = store(inp.interactions(spark, sf), "interactions")
    return numbered(it.kcore(rows), rows)


@query
def user_ids(spark, sf):
    return idm.user_ids(inp.interactions(spark, sf))


@query
def item_ids(spark, sf):
    return numbered(inp.interactions(spark, sf))[2]


@query
def encoded_sequences(spark, sf):
    return numbered(inp.interactions(spark, sf))[3]


@query
def popularity(spark, sf):
    encoded = store(numbered(inp.clicks(spark, sf))[3], "encoded")
    return rounded(it.popularity(encoded), "probability")


# --- metadata and attributes ----------------------------------------------------------------


def core_items(spark: SparkSession, sf: str) -> DataFrame:
    return it.drop_under_core(inp.interactions(spark, sf), 5, 28).select("category", "item").distinct()


@query
def aligned_items(spark, sf):
    aligned = im.normalize(im.align(inp.product_versions(spark, sf), core_items(spark, sf)))
    return aligned.withColumn("categories", joined("categories", "|"))


@query
def meta_last_wins(spark, sf):
    known = im.latest(inp.product_versions(spark, sf), core_items(spark, sf))
    return known.select("category", "asin", "item_order", "title", "brand")


def known_items(spark: SparkSession, sf: str):
    """(items with metadata, item ids) for the whole interaction table."""
    items = numbered(inp.interactions(spark, sf))[2]
    return store(im.latest(inp.product_versions(spark, sf), items), "latest"), items


def attribute_parts(spark: SparkSession, sf: str, floor: int = 0):
    known, items = known_items(spark, sf)
    rows = at.keep_frequent(at.attribute_rows(known), floor)
    return known, items, rows, store(at.attribute_ids(rows), "attribute-ids")


@query
def attribute_counts(spark, sf):
    known, _ = known_items(spark, sf)
    return at.attribute_counts(at.attribute_rows(known))


@query
def attribute_floor(spark, sf):
    known, _ = known_items(spark, sf)
    kept = at.keep_frequent(at.attribute_rows(known), 8)
    return kept.select("category", "asin", "pos", "attribute")


@query
def attribute_ids(spark, sf):
    return attribute_parts(spark, sf)[3]


@query
def item_attributes(spark, sf):
    known, items, rows, names = attribute_parts(spark, sf)
    lists = at.item_attributes(known, rows, names, items)
    return lists.withColumn("attribute_ids", joined("attribute_ids"))


@query
def attribute_stats(spark, sf):
    known, items, rows, names = attribute_parts(spark, sf, 8)
    stats = at.attribute_stats(at.item_attributes(known, rows, names, items), items)
    return rounded(stats, "avg_attributes", "match_ratio")


# --- negatives ------------------------------------------------------------------------------


def encoded_core(spark: SparkSession, sf: str) -> DataFrame:
    return store(numbered_core(spark, sf)[3], "encoded")


def encoded_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return store(numbered(inp.clicks(spark, sf))[3], "encoded")


@query
def negatives_random(spark, sf):
    return ng.sample_negatives(encoded_core(spark, sf), 20)


@query
def negatives_pop(spark, sf):
    return ng.sample_negatives(encoded_core(spark, sf), 20, mode="pop")


@query
def negatives_short(spark, sf):
    return ng.sample_negatives(encoded_clicks(spark, sf))


@query
def negatives_short_pop(spark, sf):
    return ng.sample_negatives(encoded_clicks(spark, sf), mode="pop")


@query
def unseen_items(spark, sf):
    encoded = encoded_clicks(spark, sf)
    shifted = encoded.select("category", "user_id", (F.col("item_id") % 100 + 1).alias("item_id"))
    return ng.unseen_only(shifted, encoded)


def listed_records(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    encoded = encoded_core(spark, sf)
    key = ["category", "user_id"]
    sequences = it.chunked(encoded, key, "pos", "item_id", "item_ids")
    negatives = it.chunked(ng.sample_negatives(encoded, k), key, "neg_pos", "item_id", "neg_items")
    return ng.sequence_records(sequences, negatives)


@query
def sequence_records(spark, sf):
    records = listed_records(spark, sf)
    return records.withColumn("item_ids", joined("item_ids")).withColumn("neg_items", joined("neg_items"))


@query
def sequence_records_chunked(spark, sf):
    """Records whose lists are cut at different places, joined again."""
    encoded, key = encoded_core(spark, sf), ["category", "user_id"]
    sequences = it.chunked(encoded, key, "pos", "item_id", "item_ids", chunk=3)
    negatives = it.chunked(ng.sample_negatives(encoded, 20), key, "neg_pos", "item_id", "neg_items", chunk=3)
    records = ng.whole_records(ng.sequence_records(sequences, negatives))
    return records.withColumn("item_ids", joined("item_ids")).withColumn("neg_items", joined("neg_items"))


# --- shuffles and splits --------------------------------------------------------------------


@query
def seeded_shuffle(spark, sf):
    rows = inp.products(spark, sf).select("category", "seq")
    return sp.shuffle(rows, ["category", "seq"])


@query
def split_metadata(spark, sf):
    return sp.split(inp.products(spark, sf).select("category", "seq"), ["category", "seq"])


@query
def split_sequences(spark, sf):
    users = inp.clicks(spark, sf).select("category", "user").distinct()
    return sp.split(users, ["category", "user"], sp.sequence_eval_size)


@query
def split_by_category(spark, sf):
    rows = inp.products(spark, sf).select("category", "seq")
    return sp.split(rows, ["seq"], group=["category"])


@query
def split_capped(spark, sf):
    rows = inp.products(spark, sf).select("category", "seq")
    return sp.split(
        rows, ["category", "seq"], ratio=0.25, max_total=150, max_train=100, max_eval=30
    )


# --- product text and prompts ---------------------------------------------------------------


@query
def clean_text(spark, sf):
    return inp.table(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.clean("text").alias("cleaned"))


@query
def normalized_items(spark, sf):
    return im.normalize(inp.products(spark, sf)).withColumn("categories", joined("categories", "|"))


@query
def stringified(spark, sf):
    part = inp.products(spark, sf)
    whole = F.struct(
        "asin", "title", "categories", F.create_map(F.lit("b"), F.col("brand")).alias("m"), "seq"
    )
    frame = part.select("seq", whole.alias("whole"))
    return frame.select("seq", tx.stringify("whole", frame.schema["whole"].dataType).alias("text"))


@query
def product_names(spark, sf):
    part = inp.table(spark, sf, "part")
    titled = part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") > 15, F.concat(F.lit(" "), F.col("p_brand"))).alias("product_title"),
        F.when(F.col("p_size") > 5, F.lower("p_type")).alias("name"),
        F.array(F.col("p_name"), F.lit(None), F.col("p_type")).alias("features"),
        F.concat_ws("  ", "p_name", "p_type").alias("description"),
        F.lit("").alias("details"),
        F.array("p_brand").alias("categories"),
    )
    texts_ = im.with_text(titled, "seq")
    return texts_.select("seq", "product_name", joined("product_features", "|").alias("features"))


def item_texts(spark: SparkSession, sf: str, max_chars: int = 60) -> DataFrame:
    items = store(im.normalize(inp.products(spark, sf)), "items")
    return im.with_text(sp.split(items, ["category", "seq"]), max_chars=max_chars)


@query
def product_texts(spark, sf):
    return item_texts(spark, sf).select("seq", "split", "index", "product_name", "product_text")


def flat_turns(prompt: str):
    return F.array_join(
        F.transform(prompt, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"
    )


@query
def prompt_records(spark, sf):
    records = im.with_prompts(item_texts(spark, sf))
    return records.select(
        "seq",
        "split",
        "index",
        flat_turns("guessing_prompt").alias("guessing"),
        flat_turns("reconstruction_prompt").alias("reconstruction"),
    )


@query
def guessing_prompts(spark, sf):
    prompts = inp.table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", guessing_prompt("text", 7, 4, 32).alias("prompt")
    )
    return prompts.select("doc_id", flat_turns("prompt").alias("prompt"))


@query
def prompt_parts(spark, sf):
    records = im.with_prompts(item_texts(spark, sf))
    return records.withColumn("open", without_answer("guessing_prompt")).select(
        "seq", reference_text("reconstruction_prompt").alias("reference"), flat_turns("open").alias("open")
    )


# --- code text ------------------------------------------------------------------------------


@query
def format_ids(spark, sf):
    return inp.hashed_codes(spark, sf).select("vec_id", tx.format_ids("ids").alias("text"))


@query
def code_tokens(spark, sf):
    tokens = F.transform(tx.code_tokens("ids"), lambda t: F.coalesce(t, F.lit("null")))
    return inp.hashed_codes(spark, sf).select("vec_id", F.array_join(tokens, " ").alias("tokens"))


@query
def parse_ids(spark, sf):
    fallback = F.array(F.col("n_chars").cast("int"), F.lit(5))
    parsed = tx.parse_ids("text", 6, 99, fallback)
    documents = inp.table(spark, sf, "documents", "doc_id", "text", "n_chars")
    return documents.select("doc_id", F.array_join(
        F.transform(parsed, lambda x: x.cast("string")), ",").alias("ids"))


@query
def parse_formatted(spark, sf):
    text = inp.hashed_codes(spark, sf).withColumn("text", tx.format_ids("ids"))
    parsed = tx.parse_ids("text", 4, 12)
    return text.select("vec_id", F.array_join(F.transform(parsed, lambda x: x.cast("string")), ",").alias("ids"))


@query
def code_lookup(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.pmod(
        F.col("l_partkey") * 7 + F.col("l_suppkey") * p + F.col("l_linenumber"), F.lit(40)) + 500)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = inp.table(spark, sf, "lineitem", *key).select(*key, tokens.alias("tokens"))
    known = [500 + 2 * i for i in range(16)]
    codes = tx.lookup_codes("tokens", known, 3)
    return rows.withColumn("ids", codes).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined("ids", ",").alias("ids"))


# --- codebook quality -----------------------------------------------------------------------

NAMED = tuple(f"eval/{name}" for name in ("codebook_perplexity", "active_code_ratio", "collision_rate", "uniqueness"))
NAMED_TEXT = tuple(f"eval/{name}" for name in rc.METRICS)
QUALITY = ("codebook_perplexity", "active_code_ratio", "collision_rate", "uniqueness")


def all_tuples(spark: SparkSession, sf: str, size: int) -> DataFrame:
    return cd.with_all(store(cd.tuple_counts(inp.hashed_codes(spark, sf), size), "tuples"))


@query
def codebook_quality(spark, sf):
    return rounded(cd.whole_quality(inp.hashed_codes(spark, sf), SIZE, RANGE), *QUALITY)


@query
def quality_by_category(spark, sf):
    return rounded(cd.quality(store(all_tuples(spark, sf, SIZE), "tuples"), RANGE), *QUALITY)


@query
def quality_unknown(spark, sf):
    unknown = F.transform("ids", lambda c: F.lit(-1))
    codes = inp.hashed_codes(spark, sf).withColumn("ids", unknown)
    return rounded(cd.quality(cd.tuple_counts(codes, SIZE), RANGE), *QUALITY)


@query
def quality_capped(spark, sf):
    codes = sp.shuffle(inp.hashed_codes(spark, sf), ["vec_id"], name="index")
    return rounded(evaluation.evaluate_codes(codes, 2, RANGE, max_samples=300), *NAMED)


@query
def accumulated_quality(spark, sf):
    """Metrics reduced from the stored counts of batches in two folders, one of them replayed after a bad attempt."""
    codes = store(inp.hashed_codes(spark, sf), "codes")
    first, second = (CodeCounts(spark, new_path(spark, "code-counts"), size=SIZE) for _ in range(2))
    for batch in range(4):
        rows = codes.filter(F.col("batch_id") % 4 == batch)
        if batch == 2:
            first.add(rows.withColumn("ids", F.array(F.lit(0), F.lit(0), F.lit(0))), f"part {batch}")
        (first if batch < 2 else second).add(rows, f"part {batch}")
    both = CodeCounts(spark, *first.folders, *second.folders, size=SIZE)
    return rounded(both.quality(RANGE), *QUALITY)


@query
def collapse_histogram(spark, sf):
    return cd.multiplicity_histogram(all_tuples(spark, sf, 2))


@query
def most_shared(spark, sf):
    top = cd.most_shared(all_tuples(spark, sf, 2), 20)
    return top.withColumn("ids", joined("ids", ","))


@query
def position_histogram(spark, sf):
    return cd.position_histogram(all_tuples(spark, sf, SIZE))


@query
def position_bars(spark, sf):
    histogram = cd.position_histogram(cd.tuple_counts(inp.hashed_codes(spark, sf), SIZE))
    return cd.position_bars(histogram, SIZE, RANGE)


@query
def distinct_tuples(spark, sf):
    tuples = cd.tuple_counts(inp.hashed_codes(spark, sf), SIZE)
    return tuples.withColumn("ids", joined("ids", ","))


@query
def batch_health(spark, sf):
    health = cd.batch_health(inp.hashed_codes(spark, sf), 2, RANGE)
    return rounded(health, "perplexity", "diversity", "uniqueness")


@query
def batch_position_perplexity(spark, sf):
    return rounded(cd.position_perplexity(inp.hashed_codes(spark, sf), SIZE), "perplexity")


# --- text fidelity --------------------------------------------------------------------------


@query
def answer_tokens(spark, sf):
    texts_ = inp.near_copies(spark, sf).withColumn("normal", tx.normalize_answer("prediction"))
    return texts_.select("doc_id", "normal", F.size(tx.tokens("normal")).alias("tokens"))


@query
def recon_exact(spark, sf):
    return rc.score(inp.near_copies(spark, sf), metrics=("recon_exact_match",)).select(
        "doc_id", "recon_exact_match"
    )


@query
def recon_token_f1(spark, sf):
    scored = rc.score(inp.near_copies(spark, sf), metrics=("recon_token_f1",))
    return rounded(scored.select("doc_id", "recon_token_f1"), "recon_token_f1")


@query
def recon_rouge_l(spark, sf):
    scored = rc.score(inp.turn_pairs(spark, sf), metrics=("recon_rouge_l",))
    return rounded(scored.select("conv_id", "turn", "recon_rouge_l"), "recon_rouge_l")


@query
def recon_summary(spark, sf):
    return rounded(rc.summary(rc.score(inp.turn_pairs(spark, sf))), *rc.METRICS)


@query
def recon_examples(spark, sf):
    return rc.examples(inp.near_copies(spark, sf), "doc_id")


@query
def rec_report(spark, sf):
    report = evaluation.evaluate_reconstruction(
        inp.hashed_codes(spark, sf), inp.turn_pairs(spark, sf), SIZE, RANGE
    )
    return rounded(report, *NAMED, *NAMED_TEXT)


# --- sources and sinks ----------------------------------------------------------------------


def quoted(column: str):
    """The value as a Python literal."""
    escaped = F.regexp_replace(F.col(column), r"([\\'])", r"\\$1")
    literal = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(escaped, "\n", r"\\n"), "\t", r"\\t"), F.lit("'"))
    return F.coalesce(literal, F.lit("None"))


def write_product_lines(spark: SparkSession, sf: str) -> str:
    """Gzip dict lines of all products, one folder per category; those of size 17 are malformed."""
    part = inp.products(spark, sf)
    labels = F.transform("categories", lambda p: F.concat(F.lit("['"), F.array_join(p, "', '"), F.lit("']")))
    brand = F.when(F.col("brand").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(", 'brand': u"), quoted("brand"))
    )
    line = F.concat(
        F.lit("{'asin': "), quoted("asin"), F.lit(", 'title': "), quoted("title"),
        F.lit(", 'description': "), quoted("description"), F.lit(", 'price': 1.5, 'sold': True"),
        F.lit(", 'categories': ["), F.array_join(labels, ", "), F.lit("]"), brand, F.lit("}"),
    )
    broken = F.concat(line, F.when(F.col("description").endswith("size 17"), F.lit(" trailing")).otherwise(F.lit("")))
    path = new_path(spark, "product-lines")
    part.select("category", broken.alias("value")).write.partitionBy("category").option(
        "compression", "gzip"
    ).text(path)
    return path


def category_folders(spark: SparkSession, sf: str, path: str) -> dict[str, str]:
    found = inp.table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()
    return {r["p_type"]: f"{path}/category={r['p_type']}" for r in found}


@query
def loose_dict_scan(spark, sf):
    paths = category_folders(spark, sf, write_product_lines(spark, sf))
    read = loose.read_metadata(spark, paths)
    return read.withColumn("categories", joined(F.transform("categories", lambda p: F.array_join(p, ">")), "|")).select(
        "category", "asin", "title", "description", "categories", "brand"
    )


@query
def loose_reviews(spark, sf):
    line = F.concat(
        F.lit("{'reviewerID': '"), F.col("user"), F.lit("', 'asin': '"), F.col("item"),
        F.lit("', 'overall': "), F.col("overall").cast("string"),
        F.lit(", 'helpful': [0, 0], 'unixReviewTime': "), F.col("ts").cast("string"), F.lit("}"),
    )
    path = new_path(spark, "review-lines")
    rows = inp.purchases(spark, sf).select("category", line.alias("value"))
    rows.write.partitionBy("category").option("compression", "gzip").text(path)
    read = loose.read_interactions(spark, category_folders(spark, sf, path))
    return read.groupBy("category", "user", "item", "ts").agg(F.count(F.lit(1)).alias("n"))


@query
def structured_scan(spark, sf):
    path = new_path(spark, "products-json")
    part = inp.products(spark, sf)
    part.select(
        "category",
        F.col("seq").alias("ignored"),
        "title",
        F.array("description").alias("description"),
        F.col("brand").alias("details"),
        F.array("asin").alias("features"),
        F.array("category").alias("categories"),
    ).write.partitionBy("category").json(path)
    read = structured.read_products(spark, category_folders(spark, sf, path))
    texts_ = im.with_text(read.withColumn("index", F.lit(0)))
    return texts_.select("category", "product_name", joined("product_features", "|").alias("features"))


def under_split_sizes(spark: SparkSession, make) -> list[DataFrame]:
    """What ``make()`` reads when Spark cuts files into small and into large pieces."""
    found, key = [], "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("20000", "134217728"):
            spark.conf.set(key, size)
            found.append(store(make(), "read"))
    finally:
        spark.conf.set(key, before)
    return found


@query
def split_layout_free(spark, sf):
    """One split of products in uneven files, read in small and in large pieces: sizes and differences."""
    path = new_path(spark, "uneven-products")
    part = inp.products(spark, sf).select("category", "title", F.array("description").alias("description"))
    uneven = F.when(F.length("title") % 5 == 0, F.lit(1)).otherwise(F.pmod(F.crc32("title"), F.lit(3)))
    part.repartition(4, uneven).write.json(path)
    settings = corpus.Settings(categories=("all",), ratio=0.25)

    def split_rows():
        items = structured.read_products(spark, {"all": path}).drop("index")
        placed = corpus.prompt_records(items, settings).select("product_text", "split", "index")
        return placed.select(F.sha2("product_text", 256).alias("text"), "split", "index")

    small, large = under_split_sizes(spark, split_rows)
    differing = small.exceptAll(large).unionByName(large.exceptAll(small))
    sizes = small.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("split") == "eval", 1)).alias("evals"))
    one = F.lit(1).alias("one")
    return sizes.select("*", one).join(differing.agg(F.count(F.lit(1)).alias("differing")).select("*", one), "one").drop("one")


@query
def file_order_ties(spark, sf):
    """Place of every line of several uneven files, read in small and in large pieces."""
    path = new_path(spark, "uneven-lines")
    part = inp.table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    folder = F.when(F.col("p_size") < 5, 0).when(F.col("p_size") < 40, 1).otherwise(2).alias("b")
    lines = part.select(folder, "p_partkey", F.concat_ws(" ", "p_partkey", "p_name").alias("value"))
    ordered = lines.repartitionByRange("b", "p_partkey").sortWithinPartitions("b", "p_partkey")
    ordered.select("b", "value").write.partitionBy("b").text(path)
    small, large = under_split_sizes(spark, lambda: read_lines(spark, path, "lines").withColumn("all", F.lit(0)))
    both = [positions(read, ["all"], ["seq"], "pos").select("value", "pos") for read in (small, large)]
    return both[0].withColumn("pieces", F.lit("small")).unionByName(both[1].withColumn("pieces", F.lit("large")))


@query
def text_inputs(spark, sf):
    path = new_path(spark, "texts")
    inp.table(spark, sf, "part").select(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("value")).unionByName(
        inp.table(spark, sf, "region").select(F.lit("   ").alias("value"))
    ).write.text(path)
    read = texts.read_texts(spark, ["Wireless mouse ", "  "], path)
    counted = read.groupBy("product_text").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("_first"))
    return counted.select("product_text", "n", (F.col("_first") == 0).alias("comes_first"))


def written_artifacts(spark: SparkSession, sf: str, *wanted: str):
    """(folder, categories) with the wanted artifacts of the k-core interactions."""
    sequenced, users, items, encoded = numbered_core(spark, sf)
    encoded = store(encoded, "encoded")
    root = new_path(spark, "artifacts")
    if art.SEQUENCES in wanted:
        snk.write_sequences(encoded, root)
    if art.NEGATIVES in wanted:
        snk.write_negatives(ng.sample_negatives(encoded, 20), root)
    if art.ITEM_ATTRIBUTES in wanted or art.ID_MAPS in wanted:
        known = store(im.latest(inp.product_versions(spark, sf), items), "latest")
        rows = at.attribute_rows(known)
        names = store(at.attribute_ids(rows), "attribute-ids")
        if art.ITEM_ATTRIBUTES in wanted:
            snk.write_item_attributes(at.item_attributes(known, rows, names, items), root)
        if art.ID_MAPS in wanted:
            snk.write_id_maps(users, items, names, root, chunk=100)
    return root, list(category_folders(spark, sf, root))


@query
def artifact_sequences(spark, sf):
    root, categories = written_artifacts(spark, sf, art.SEQUENCES)
    return art.read_sequences(spark, root, categories).withColumn("item_ids", joined("item_ids"))


@query
def artifact_category_folders(spark, sf):
    """Sequences in one folder per category, as the artifacts' other layout has them."""
    root, categories = written_artifacts(spark, sf, art.SEQUENCES)
    out = new_path(spark, "category-folders")
    snk.to_category_folders(spark, root, out)
    return art.read_sequences(spark, out, categories, partitioned=False).withColumn("item_ids", joined("item_ids"))


def tagged(name: str):
    return lambda e: F.struct(F.lit(name).alias("map"), e["key"].alias("key"), e["value"].alias("value"))


@query
def artifact_id_maps(spark, sf):
    """Every entry of the seven id maps."""
    root, categories = written_artifacts(spark, sf, art.ID_MAPS)
    lines = art.artifact_lines(spark, root, art.ID_MAPS, categories)
    names = ["user2id", "id2user", "item2id", "id2item", "attribute2id", "id2attribute", "attributeid2num"]
    maps = F.from_json("value", ", ".join(f"{n} map<string,string>" for n in names))
    entries = F.concat(*[F.transform(F.map_entries(maps[n]), tagged(n)) for n in names])
    return lines.select("category", F.explode(entries).alias("e")).select("category", "e.*")


@query
def artifact_negatives(spark, sf):
    root, categories = written_artifacts(spark, sf, art.NEGATIVES)
    return art.read_negatives(spark, root, categories).withColumn("neg_items", joined("neg_items"))


@query
def artifact_item_ids(spark, sf):
    root, categories = written_artifacts(spark, sf, art.ID_MAPS)
    return art.read_item_ids(spark, root, categories)


@query
def artifact_item_attributes(spark, sf):
    root, categories = written_artifacts(spark, sf, art.ITEM_ATTRIBUTES)
    lists = art.read_item_attributes(spark, root, categories)
    return lists.withColumn("attribute_ids", joined("attribute_ids"))


@query
def sequence_corpus(spark, sf):
    root, categories = written_artifacts(spark, sf, art.SEQUENCES, art.NEGATIVES)
    config = {"dataset_mode": "sequential", "sequential_dir": root, "categories": categories}
    records = corpus.load_corpus(spark, config)
    return records.withColumn("item_ids", joined("item_ids")).withColumn("neg_items", joined("neg_items"))


@query
def preprocess_run(spark, sf):
    result = preprocess(inp.interactions(spark, sf), inp.product_versions(spark, sf), negatives=5)
    drawn = result.negatives.groupBy("category").agg(F.count(F.lit(1)).alias("negatives"))
    found = result.attribute_stats.drop("items")
    joined_ = result.stats.join(found, "category").join(drawn, "category")
    return rounded(joined_, "avg_len", "sparsity", "avg_attributes", "match_ratio")


@query
def item_corpus(spark, sf):
    root, categories = written_artifacts(spark, sf, art.ID_MAPS)
    config = {
        "dataset_version": 2014,
        "metadata_dir": write_product_lines(spark, sf),
        "filename_template": "category={category}",
        "sequential_dir": root,
        "categories": categories,
    }
    items = corpus.item_corpus(spark, config)
    return items.withColumn("categories", joined("categories", "|")).drop("seq")


def corpus_sides(records: DataFrame) -> DataFrame:
    """Per side of the split: records, their index range, and how many have whole prompts."""
    whole = (F.size("guessing_prompt") == 3) & (F.size("reconstruction_prompt") == 3) & (F.length("product_text") > 0)
    return records.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.min("index").cast("bigint").alias("first"), F.max("index").cast("bigint").alias("last"),
        F.count_distinct("index").alias("indexes"), F.count(F.when(whole, 1)).alias("prompts"),
    )


@query
def loose_corpus(spark, sf):
    """Records of the mode that reads dict-literal metadata, restricted to the items of artifacts."""
    root, categories = written_artifacts(spark, sf, art.ID_MAPS)
    config = {
        "dataset_version": 2014, "metadata_dir": write_product_lines(spark, sf), "filename_template": "category={category}",
        "sequential_dir": root, "categories": categories,
    }
    return corpus_sides(corpus.load_corpus(spark, config))


@query
def structured_corpus(spark, sf):
    """Records of the mode that reads structured product files."""
    path = new_path(spark, "structured-products")
    part = inp.products(spark, sf)
    part.select(
        "category", "title", F.array("description").alias("description"), F.array("asin").alias("features"),
    ).write.partitionBy("category").json(path)
    paths = category_folders(spark, sf, path)
    settings = corpus.Settings(categories=tuple(paths), product_paths=paths, ratio=0.2, version="2023")
    return corpus_sides(corpus.load_corpus(spark, settings))


@query
def preprocess_files_run(spark, sf):
    """One run from review and product files to artifacts, which are then read back and counted."""
    folder, out = new_path(spark, "raw-files"), new_path(spark, "run-artifacts")
    line = F.concat(
        F.lit("{'reviewerID': '"), F.col("user"), F.lit("', 'asin': '"), F.col("item"), F.lit("', 'overall': "),
        F.col("overall").cast("string"), F.lit(", 'unixReviewTime': "), F.col("ts").cast("string"), F.lit("}"),
    )
    product = F.concat(F.lit("{'asin': '"), F.col("asin"), F.lit("', 'brand': "), quoted("brand"), F.lit("}"))
    for rows, file in ((inp.purchases(spark, sf).select(line), loose.REVIEW_FILE), (inp.products(spark, sf).select(product), loose.METADATA_FILE)):
        rows.toDF("value").write.option("compression", "gzip").text(f"{folder}/{file.format(category='all')}")
    preprocess_files(spark, ["all"], folder, out, negatives=5)
    sequences = art.read_sequences(spark, out, ["all"])
    counts = [
        sequences.agg(F.count_distinct("user_id").alias("n")).withColumn("what", F.lit("users")),
        sequences.agg(F.sum(F.size("item_ids")).alias("n")).withColumn("what", F.lit("interactions")),
        art.read_item_ids(spark, out, ["all"]).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("items")),
        art.read_negatives(spark, out, ["all"]).agg(F.sum(F.size("neg_items")).alias("n")).withColumn("what", F.lit("negatives")),
        art.read_item_attributes(spark, out, ["all"]).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("described")),
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


@query
def sparse_code_lookup(spark, sf):
    """Codes of tokens that lie far apart, some beyond 32 bits, as large vocabularies may number them."""
    known = [7 + 999_983 * c * c * c for c in range(RANGE)]
    token = F.transform("ids", lambda c: F.when(c >= 0, F.lit(7) + F.lit(999_983) * c.cast("bigint") * c * c).otherwise(F.lit(5)))
    codes = tx.lookup_codes("tokens", known, SIZE)
    return inp.hashed_codes(spark, sf).select("vec_id", token.alias("tokens")).select("vec_id", joined(codes, ",").alias("ids"))


@query
def metrics_json(spark, sf):
    path = new_path(spark, "metrics")
    row = evaluation.evaluate_codes(inp.hashed_codes(spark, sf), SIZE, RANGE)
    reports.write_metrics(row, path)
    return rounded(spark.read.schema(row.schema).json(path), *NAMED)


@query
def rec_metrics_json(spark, sf):
    path = new_path(spark, "rec-metrics")
    row = evaluation.evaluate_reconstruction(
        inp.hashed_codes(spark, sf), inp.turn_pairs(spark, sf), SIZE, RANGE
    )
    reports.write_metrics(row, path)
    return rounded(spark.read.schema(row.schema).json(path), *NAMED, *NAMED_TEXT)


@query
def report_json(spark, sf):
    path = new_path(spark, "report")
    names = [f"label{i}" for i in range(10)] + ["absent"]
    report = evaluation.evaluate_by_category(inp.hashed_codes(spark, sf), names, 2, RANGE)
    reports.write_metrics(report, path)
    read = spark.read.schema(report.schema).json(path)
    parts = read.select(F.explode("per_category").alias("category", "r")).unionByName(
        read.select(F.lit(cd.ALL).alias("category"), F.col("global").alias("r"))
    )
    flat = parts.select(
        "category",
        *[F.col(f"r.{c}").alias(c) for c in QUALITY],
        "r.active_codes", "r.dead_codes", "r.num_items", "r.num_unique_ids",
        F.col("r.collapse.max_products_sharing_one_id").alias("max_sharing"),
        F.size("r.collapse.multiplicity_histogram").alias("histogram_bars"),
        F.get("r.collapse.most_shared_ids", F.lit(0))["count"].alias("top_count"),
        joined(F.get("r.collapse.most_shared_ids", F.lit(0))["tuple"], ",").alias("top_tuple"),
        F.size(F.element_at("r.position_histograms", "0")).alias("first_position_codes"),
    )
    return rounded(flat, *QUALITY)


@query
def assignments_jsonl(spark, sf):
    path = new_path(spark, "assignments")
    named = inp.hashed_codes(spark, sf).withColumn("product_name", F.concat_ws("-", "category", "vec_id"))
    rows = reports.assignments(named, "ids")
    reports.write_records(rows, path)
    read = spark.read.schema(rows.schema).json(path)
    tokens = F.transform("semantic_id_tokens", lambda t: F.coalesce(t, F.lit("null")))
    return read.select(
        "product_name", joined("semantic_ids", ",").alias("ids"), F.array_join(tokens, " ").alias("tokens")
    )


# --- codes for items ------------------------------------------------------------------------


def make_hash_predict():
    """Stands in for a model: token ids from the digest of the prompt text."""

    def predict(prompts: np.ndarray) -> np.ndarray:
        rows = [
            [
                500 + int(hashlib.md5(f"{p}:{text}".encode()).hexdigest()[:6], 16) % (RANGE + 2)
                for p in range(SIZE + 1)
            ]
            for text in prompts
        ]
        return np.array(rows, dtype="int64")

    return predict


def generated(spark: SparkSession, sf: str) -> DataFrame:
    texts_ = inp.table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.col("text").alias("product_text"),
        F.array(F.struct(F.md5("text").alias("m"))).alias("prompt"),
    )
    tokens = [500 + i for i in range(RANGE)]
    return qz.generate(texts_, make_hash_predict, tokens, SIZE, "prompt")


@query
def batch_apply(spark, sf):
    return generated(spark, sf).select(
        "conv_id", "turn", joined("semantic_ids", ",").alias("ids"), "semantic_id_text"
    )


@query
def generated_jsonl(spark, sf):
    path = new_path(spark, "generated")
    rows = reports.generated(generated(spark, sf))
    reports.write_records(rows, path)
    read = spark.read.schema(rows.schema).json(path)
    return read.groupBy(
        "product_text", joined("semantic_ids", ",").alias("ids"), "semantic_id_text"
    ).agg(F.count(F.lit(1)).alias("n"))


def label_codebook(spark: SparkSession, sf: str, levels: int = 2) -> DataFrame:
    """Centroids per label: mean vectors, then mean residuals of what the first level leaves."""
    vectors = inp.table(spark, sf, "embeddings")
    rest = vectors.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    books = []
    for level in range(levels):
        dims = rest.select("label", F.posexplode("v").alias("dim", "x"))
        means = dims.groupBy("label", "dim").agg(F.avg(F.col("x").cast("decimal(38,18)")).alias("m"))
        book = means.groupBy("label").agg(
            F.array_sort(F.collect_list(F.struct("dim", F.round("m", 6).cast("double").alias("m")))).alias("_m")
        ).select(F.lit(level).alias("level"), F.col("label").alias("code"), F.col("_m.m").alias("centroid"))
        book = store(book, "codebook")
        books.append(book)
        if level + 1 < levels:
            one = book.withColumn("level", F.lit(0))
            rest = store(qz.residual_codes(rest, one, 1, "v").select(
                "label", F.col("residual").alias("v")), "rest")
    whole = books[0]
    for book in books[1:]:
        whole = whole.unionByName(book)
    return store(whole, "codebook")


def coded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = inp.table(spark, sf, "embeddings")
    return qz.residual_codes(vectors, label_codebook(spark, sf), 2)


@query
def residual_codes(spark, sf):
    return coded_vectors(spark, sf).select("vec_id", joined("ids", ",").alias("ids"))


@query
def residual_error(spark, sf):
    errors = qz.reconstruction_error(coded_vectors(spark, sf))
    return rounded(errors.select("vec_id", "squared_error", "cosine"), "squared_error", "cosine")


@query
def decoded_vectors(spark, sf):
    coded = store(coded_vectors(spark, sf).select("vec_id", "ids"), "coded")
    rebuilt = qz.decode(coded, label_codebook(spark, sf), 2)
    return rebuilt.select(
        "vec_id", F.round(F.aggregate("rebuilt", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2")
    )


@query
def codebook_fit(spark, sf):
    book = store(qz.fit_codebook(inp.table(spark, sf, "embeddings"), 2, 8, max_iter=5), "codebook")
    coded = qz.residual_codes(inp.table(spark, sf, "embeddings"), book, 2)
    first = qz.reconstruction_error(qz.residual_codes(inp.table(spark, sf, "embeddings"), book, 1))
    rows = store(qz.reconstruction_error(coded).join(first.select("vec_id", F.col("squared_error").alias("before")), "vec_id"), "errors")
    per_level = rows.select(F.posexplode("ids").alias("level", "code"), "squared_error", "before")
    return per_level.groupBy("level").agg(
        F.count(F.lit(1)).alias("items"),
        (F.sum("squared_error") <= F.sum("before")).alias("error_falls"),
        (F.max("code") < 8).alias("known_codes"),
    ).join(book.groupBy("level").agg(F.count(F.lit(1)).alias("codes")), "level")


@query
def codebook_loads(spark, sf):
    """Codes of a large codebook that vectors take: none is left unused."""
    vectors = inp.table(spark, sf, "embeddings")
    book = store(qz.fit_codebook(vectors, 2, 96, max_iter=3), "codebook")
    coded = qz.residual_codes(vectors, book, 2)
    taken = coded.select(F.posexplode("ids").alias("level", "code"))
    return taken.groupBy("level").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("code").alias("used_codes"))


@query
def residual_codes_far(spark, sf):
    """The same codes as with a codebook that is sent whole, from groups of at most three centroids."""
    vectors = inp.table(spark, sf, "embeddings")
    coded = qz.residual_codes(vectors, label_codebook(spark, sf), 2, slice_bytes=3 * 64 * 8)
    return coded.select("vec_id", joined("ids", ",").alias("ids"))


@query
def residual_codes_nulls(spark, sf):
    """Codes when every seventh vector is missing."""
    vectors = inp.table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 > 0, F.col("embedding")))
    coded = qz.residual_codes(vectors, label_codebook(spark, sf), 2)
    return coded.select("vec_id", joined("ids", ",").alias("ids"))


# --- recommendation lists, baselines and collisions -----------------------------------------


def supplier_lists(spark: SparkSession, sf: str):
    """(ranked, relevant): suppliers by what a customer bought of them early, and those bought of late, by lines."""
    lines = inp.table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    orders = inp.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), "l_quantity",
        (F.year("o_orderdate") >= 1996).alias("late"),
    )
    rows = store(rows, "supplier-lines")
    early = rows.filter("not late").groupBy("user", "item").agg(F.sum("l_quantity").alias("score"))
    return early, rows.filter("late").groupBy("user", "item").agg(F.count(F.lit(1)).alias("gain"))


def ranking_row(metrics: DataFrame) -> DataFrame:
    return rounded(metrics, *rm.METRICS, "mrr")


@query
def ranking_metrics(spark, sf):
    return ranking_row(rm.ranking_metrics(*supplier_lists(spark, sf)))


@query
def ranking_per_user(spark, sf):
    users = rm.per_user(*supplier_lists(spark, sf), cutoffs=(5, 10))
    return rounded(users, "mrr", *[f"{m}_{k}" for k in (5, 10) for m in rm.METRICS])


@query
def ranking_by_category(spark, sf):
    """Raw click lists with repeated items and many ties, per kind of event; what follows at night is relevant."""
    rows = inp.table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props", "value").select(
        F.col("event_type").alias("category"), F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("item"), F.floor(F.col("value") / 4).alias("score"),
        (F.hour("ts") >= 20).alias("night"),
    )
    rows = store(rows, "clicks")
    found = rm.ranking_metrics(rows.filter("not night"), rows.filter("night").drop("score"), group=("category",))
    return ranking_row(found)


@query
def prefix_purity(spark, sf):
    found = px.label_purity(inp.hashed_codes(spark, sf), SIZE, "category")
    return rounded(found.withColumn("prefix", joined("prefix", ",")), "purity", "entropy")


def labelled_codes(spark: SparkSession, sf: str) -> DataFrame:
    return store(coded_vectors(spark, sf).select("vec_id", "label", "ids", "embedding"), "coded")


@query
def prefix_purity_by_length(spark, sf):
    found = px.purity_by_length(px.label_purity(labelled_codes(spark, sf), 2))
    return rounded(found, "purity", "entropy")


@query
def prefix_cosine(spark, sf):
    vectors = inp.table(spark, sf, "embeddings").select("vec_id", "embedding")
    codes = inp.hashed_codes(spark, sf).join(vectors, "vec_id")
    found = px.pair_cosine(codes, SIZE)
    return rounded(found.withColumn("prefix", joined("prefix", ",")), "cosine")


@query
def prefix_cosine_by_length(spark, sf):
    return rounded(px.cosine_by_length(px.pair_cosine(labelled_codes(spark, sf), 2)), "cosine")


def numbered_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = store(inp.table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("all")), "vectors")
    return positions(rows, ["all"], ["vec_id"]).select("vec_id", (F.col("pos") - 1).alias("number"))


@query
def baseline_hash_ids(spark, sf):
    items = inp.table(spark, sf, "part").select("p_partkey")
    return bl.hash_ids(items, ["p_partkey"], SIZE, RANGE).withColumn("ids", joined("ids", ","))


@query
def baseline_random_ids(spark, sf):
    """Random tuples of two codes out of 61 for the items of each category, by their dense ids."""
    items = numbered(inp.interactions(spark, sf))[2]
    coded = bl.random_ids(items, "item_id", 2, 61, first=1)
    return coded.select("category", "item_id", joined("ids", ",").alias("ids"))


@query
def baseline_quality(spark, sf):
    """Metrics of learned, hashed and random codes of the same items side by side."""
    rows = numbered_vectors(spark, sf)
    learned = coded_vectors(spark, sf).select(F.lit("learned").alias("category"), "ids")
    hashed = bl.hash_ids(rows, ["vec_id"], SIZE, RANGE).select(F.lit("hash").alias("category"), "ids")
    drawn = bl.random_ids(rows, "number", SIZE, RANGE).select(F.lit("random").alias("category"), "ids")
    tuples = store(cd.tuple_counts(learned.unionByName(hashed).unionByName(drawn), SIZE), "tuples")
    return rounded(cd.quality(tuples, RANGE), *QUALITY)


def part_collisions(spark: SparkSession, sf: str):
    """(codes, pairs): parts with two hashed codes; parts on neighbouring lines of an order may collide."""
    codes = bl.hash_ids(inp.table(spark, sf, "part").select(F.col("p_partkey").alias("item")), ["item"], 2, RANGE)
    lines = store(inp.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "lines")
    following = lines.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("second")
    )
    pairs = lines.withColumnRenamed("l_partkey", "first").join(following, ["l_orderkey", "l_linenumber"])
    return codes, pairs.select("first", "second")


@query
def collision_split(spark, sf):
    found = cl.collision_split(*part_collisions(spark, sf), 2)
    return rounded(found, "harmful_rate", "harmful_item_rate")


@query
def tuple_collisions(spark, sf):
    return cl.tuple_collisions(*part_collisions(spark, sf), 2).withColumn("ids", joined("ids", ","))


@query
def code_comparison(spark, sf):
    """Learned, hashed and random codes side by side; neighbours in the table may share a tuple."""
    coded = labelled_codes(spark, sf)
    pairs = coded.select(F.col("vec_id").alias("first"), (F.col("vec_id") + 1).alias("second"))
    found = comparison.compare_codes(coded, pairs, 2, RANGE, item="vec_id")
    return rounded(
        found, "purity", "entropy", "cosine", "codebook_perplexity", "collision_rate", "uniqueness", "harmful_rate", "harmful_item_rate"
    )
