"""Evaluation jobs over assigned codes and reconstructed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.prompts import reference_text
from tesserae.operators.codes import ALL, whole_quality
from tesserae.operators.quantize import generate, rebuild
from tesserae.operators.reconstruction import examples, score, summary
from tesserae.operators.splits import first_rows
from tesserae.sinks import reports
from tesserae.workspace import store


def evaluate_codes(codes: DataFrame, size: int, code_range: int, max_samples: int | None = None) -> DataFrame:
    """One row of quality metrics over the split, or over its first ``max_samples`` rows, under their file names."""
    if max_samples is not None:
        codes = first_rows(codes, max_samples)
    return reports.metric_row(whole_quality(codes, size, code_range))


def evaluate_by_category(
    codes: DataFrame, categories: list[str], size: int, code_range: int,
    max_samples: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """One row with the global and per-category reports; the cap applies inside each category."""
    if ALL in categories:
        raise ValueError(f"{ALL!r} stands for all categories and cannot name one")
    spark = codes.sparkSession
    asked = spark.createDataFrame([(c,) for c in categories], "category string")
    chosen = first_rows(codes.join(asked, "category", "left_semi"), max_samples)
    per_category = reports.category_report(chosen, size, code_range, groups=asked)
    return reports.nested_report(per_category, categories, size, code_range, checkpoint)


def evaluate_reconstruction(codes: DataFrame, pairs: DataFrame, size: int, code_range: int) -> DataFrame:
    """One row with the quality metrics of the codes and the text metrics of the pairs, under their file names."""
    quality = reports.metric_row(whole_quality(codes, size, code_range))
    texts = reports.metric_row(summary(score(pairs)))
    both = quality.unionByName(texts, allowMissingColumns=True)
    return both.agg(*[F.max(f"`{c}`").alias(c) for c in both.columns])


def generate_and_score(
    records: DataFrame, make_codes, make_texts, codebook_tokens: list[int], size: int,
    max_samples: int | None = None, log_examples: int = 5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, assignments, examples) of one pass over prompt records (``index``, ``product_name``, prompts).

    ``make_codes()`` gives a function from guessing prompts to token ids, ``make_texts()`` one from
    reconstruction prompts and codes to texts; both run in batches on the workers. The cap keeps
    the records with an index below it. The coded and rebuilt records are stored once.
    """
    chosen = first_rows(records, max_samples)
    coded = generate(chosen, make_codes, codebook_tokens, size)
    rebuilt = rebuild(coded, make_texts).withColumn("reference", reference_text("reconstruction_prompt"))
    rebuilt = store(rebuilt, "scored")
    codes = rebuilt.select(F.col("semantic_ids").alias("ids"))
    metrics = evaluate_reconstruction(codes, rebuilt.select("prediction", "reference"), size, len(codebook_tokens))
    return metrics, reports.assignments(rebuilt), examples(rebuilt, "index", log_examples)
