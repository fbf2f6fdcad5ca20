"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import archives, conversations, divergence, extraction, factorization, packing, prefix_bpe
from tesserae.llm import resampling, sentences, simhash, topk, urls
from tesserae.llm.sql import ORACLES  # noqa: F401
from tesserae.llm.substrings import Repeats


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def op1_factorization_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs, labels = read(spark, sf, "documents", "doc_id", "text", "n_chars"), read(spark, sf, "labels", "doc_id", "quality")
    return factorization.score(docs, labels)


def op2_seekable_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to seekable bundles and read back."""
    found = archives.read(archives.write(read(spark, sf, "pages", "page_id", "url", "html")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_hierarchical_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of at most 1024 tokens."""
    found = packing.pieces(read(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(found)


def op4_norm_bucketed_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all other vectors."""
    return topk.search(read(spark, sf, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every document under fingerprints of 3-word shingles that differ in at most 3 bits."""
    found = simhash.near_duplicates(read(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_distribution_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts, distances from the language references and verdict of every document."""
    return divergence.judge(read(spark, sf, "documents", "doc_id", "text", "lang"))


def op7_digest_array_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page address."""
    return urls.judge(read(spark, sf, "pages", "page_id", "url"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What every document keeps without 50-word passages that start in a document with a smaller id."""
    return Repeats(read(spark, sf, "documents", "doc_id", "text")).judged()


def op9_offset_preserving_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's SentencePiece ids and of the text that they decode to."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return sentences.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op10_boosted_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(read(spark, sf, "pages", "page_id", "url", "html"))


def op11_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of the conversations, rebuilt to share beginnings."""
    turns = conversations.turns(read(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    return conversations.trie(conversations.rebuilt(turns))


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark texts."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return resampling.resample(docs, read(spark, sf, "benchmark", "text"))


def op13_prefix_sharing_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the text that they decode to."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    return prefix_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("op")}
