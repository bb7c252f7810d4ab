"""Scoring of forecast answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring


def scored(
    answers: DataFrame,
    response: str = "response",
    mean: str = "gt_mean",
    std: str = "gt_std",
) -> DataFrame:
    """Add ``tool_call_score``, ``nll_score``, ``total_score`` and ``error``.

    The text is searched once per row: each step is a column of its own.
    """
    kept = answers.columns
    rows = answers.withColumns(
        {
            "__calls": scoring.tool_calls(F.col(response)),
            "__pair": scoring.boxed_numbers(scoring.answer_part(F.col(response))),
        }
    )
    rows = rows.withColumns(
        {
            "tool_call_score": scoring.chi_square_density(F.col("__calls")),
            "__mean": F.get("__pair", F.lit(0)).try_cast("double"),
            "__std": F.get("__pair", F.lit(1)).try_cast("double"),
        }
    )
    failed = F.col("__mean").isNull() | F.col("__std").isNull()
    divergence = scoring.gaussian_divergence(
        F.col("__mean"), F.col("__std"), F.col(mean), F.col(std)
    )
    score = F.greatest(F.lit(1.0) - divergence * scoring.NLL_WEIGHT, F.lit(-1.0))
    rows = rows.withColumn("nll_score", F.when(failed, F.lit(-1.0)).otherwise(score))
    total = F.col("tool_call_score") + F.col("nll_score")
    return rows.select(
        *kept,
        "tool_call_score",
        "nll_score",
        F.when(failed, F.lit(-1.0)).otherwise(total).alias("total_score"),
        F.when(failed, F.lit("Failed to extract numerical answer")).alias("error"),
    )


def pending(questions: DataFrame, scored_before: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a score yet."""
    return questions.join(scored_before.select(key), key, "left_anti")
