"""Scores of forecast answers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score.
DEGREES_OF_FREEDOM = 15
NLL_WEIGHT = 0.1
TRUTH_SPREAD = 0.05
ANSWER_SPREAD = 0.01
SMALLEST_STD = 1e-9

_BOXED = r"\\boxed\{([^}]*)\}\s*\\pm\s*\\boxed\{([^}]*)\}"


def tool_calls(response: Column) -> Column:
    """Number of complete ``<tool_call>`` blocks; a block may span lines."""
    return F.regexp_count(response, F.lit("(?s)<tool_call>.*?</tool_call>"))


def answer_part(response: Column) -> Column:
    """What follows the last tool call and the last thinking mark."""
    return F.substring_index(F.substring_index(response, "</tool_call>", -1), "</think>", -1)


def boxed_numbers(text: Column) -> Column:
    r"""The two texts of the first ``\boxed{a} \pm \boxed{b}`` as an array, found in one search."""
    whole = F.regexp_substr(text, F.lit(_BOXED))
    inner = F.regexp_extract_all(whole, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1))
    return inner


def boxed_pair(text: Column) -> Column:
    r"""``\boxed{a} \pm \boxed{b}`` -> struct(mean, std); nulls when absent or not numeric."""
    pair = boxed_numbers(text)
    return F.struct(
        F.get(pair, F.lit(0)).try_cast("double").alias("mean"),
        F.get(pair, F.lit(1)).try_cast("double").alias("std"),
    )


def chi_square_density(x: Column, dof: int = DEGREES_OF_FREEDOM) -> Column:
    scale = 1.0 / (2 ** (dof / 2) * math.gamma(dof / 2))
    x = x.cast("double")
    return F.when(x < 0, F.lit(0.0)).otherwise(
        F.lit(scale) * F.pow(x, F.lit(dof / 2 - 1)) * F.exp(-x / 2)
    )


def gaussian_divergence(mean: Column, std: Column, true_mean: Column, true_std: Column) -> Column:
    """Divergence of the answer from the truth; an unset spread falls back to a share of the mean."""

    def spread(given: Column, centre: Column, share: float) -> Column:
        chosen = F.when(given <= 0, F.abs(centre) * share).otherwise(given)
        return F.greatest(chosen, F.lit(SMALLEST_STD))

    t = spread(F.coalesce(true_std, F.lit(0.0)), true_mean, TRUTH_SPREAD)
    p = spread(std, mean, ANSWER_SPREAD)
    miss = mean - true_mean
    return F.log(t / p) + (p * p + miss * miss) / (t * t * 2) - 0.5
