"""Arithmetic on measures: guarded division, growth, scaling, lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, null when the denominator is 0 or either side is null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def growth(current: Column, previous: Column) -> Column:
    return quotient(current - previous, previous)


def percent_change(current: Column, previous: Column) -> Column:
    return growth(current, previous) * 100


def null_if_zero(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def volatility(daily_std: Column, days: Column) -> Column:
    """Period volatility ``std * sqrt(n)``; 0 when the deviation is undefined."""
    return F.coalesce(daily_std * F.sqrt(days.cast("double")), F.lit(0.0))


def days_scaled(ratio_code: Column, quarter: Column, value: Column) -> Column:
    """Turn the days-outstanding ratios into days: 365 for the year, 90 for a quarter."""
    in_days = ratio_code.isin("DSO", "DPO", "DIO", "CCC")
    return F.when(in_days, value * F.when(quarter == 0, 365).otherwise(90)).otherwise(value)


def to_int(x: Column) -> Column:
    return x.try_cast("bigint")


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))
