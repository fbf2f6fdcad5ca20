"""Filtering, deduplication and packing of a document table in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import divergence, factorization, packing, simhash
from tesserae.llm.substrings import Repeats
from tesserae.llm.tasks import free
from tesserae.workspace import store

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language.

    A null text is an empty one, which fails; a null language gives no distance verdict; repeated rows are judged alike.
    """
    return divergence.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of the corpus, predicts to be good.

    A null text is scored as an empty one; repeated rows are scored alike. Without labels of both
    kinds outside the held-out fold all documents have the same score.
    """
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return factorization.passing(docs, labels, fit_on=corpus)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id, of rows with equal ids one text.

    The operator's shingle length and bit distance are those of its query. Repeated rows count once,
    documents without an id come after all others, texts without words are one class.
    """
    name = free("_row", docs.columns)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("key")).alias(name)
    classes = simhash.near_duplicates(docs.select(row, "text"), id_column=name)
    first = classes.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.withColumn(name, row).join(first, name, "left_semi")
    return kept.dropDuplicates([name]).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that start in a document with a smaller id; emptied ones stay, empty.

    A null text becomes empty; a null id counts as larger than all others; repeated rows do not remove from each other.
    """
    found = Repeats(docs.select("doc_id", "text"))
    return found.rewritten(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens.

    A null or empty text is one piece of the end id; repeated rows are packed separately.
    """
    found = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(found)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model, 64-bit fingerprints and token ids cannot be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
