"""Text-fidelity metrics of predicted against reference texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.fidelity import f1_score, lcs_tokens, shared_tokens
from tesserae.functions.text import ANSWER_PREFIX, normalize_answer, tokens

# Metric names that must equal the reference's.
METRICS = ("recon_exact_match", "recon_token_f1", "recon_rouge_l")


def score(pairs: DataFrame, prefix: str = ANSWER_PREFIX, metrics=METRICS) -> DataFrame:
    """Adds the chosen per-pair metrics to rows with ``prediction`` and ``reference``."""
    out = pairs.withColumn("_p", normalize_answer("prediction", prefix)).withColumn(
        "_r", normalize_answer("reference", prefix)
    )
    out = out.withColumn("_np", F.size(tokens("_p"))).withColumn("_nr", F.size(tokens("_r")))
    if "recon_token_f1" in metrics:
        out = out.withColumn("_shared", shared_tokens("_p", "_r"))
    if "recon_rouge_l" in metrics:
        out = out.withColumn("_lcs", lcs_tokens("_p", "_r"))
    values = {
        "recon_exact_match": lambda: (F.col("_p") == F.col("_r")).cast("double"),
        "recon_token_f1": lambda: f1_score("_shared", "_np", "_nr"),
        "recon_rouge_l": lambda: f1_score("_lcs", "_np", "_nr"),
    }
    return out.select(*pairs.columns, *[values[m]().alias(m) for m in metrics])


def summary(scored: DataFrame, metrics=METRICS) -> DataFrame:
    """One row of means; 0 when there are no pairs."""
    return scored.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def examples(pairs: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first pairs for a reader to look at."""
    return pairs.orderBy(order).limit(n).select(order, "prediction", "reference")
