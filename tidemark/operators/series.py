"""Price, index, commodity and macro series: range reads, bars, period statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import measures
from tidemark.operators import guards
from tidemark.operators.ordered import previous_value

PRICE_UNIT = 1000


def scaled(df: DataFrame, columns: Sequence[str], factor: float = PRICE_UNIT) -> DataFrame:
    """Multiply measures by a unit factor, keeping names and order."""
    return df.select(
        *[(F.col(c) * F.lit(factor)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def series_range(
    df: DataFrame,
    key: str,
    value: str,
    start: str,
    end: str,
    columns: Sequence[str],
    time: str = "time",
    limit: str | None = None,
    whole_end_day: bool = False,
) -> DataFrame:
    """Rows of one series between two dates, in time order, never past ``limit``."""
    start, end = guards.limited_range(start, end, limit)
    return (
        df.where(
            (F.col(key) == value) & guards.in_range(F.col(time), start, end, whole_end_day)
        )
        .select(time, *columns)
        .orderBy(time)
    )


def price_range(
    df: DataFrame,
    key: str,
    value: str,
    start: str,
    end: str,
    spans: Sequence[int] = (20, 50, 200),
    measure: str = "close",
    factor: float = PRICE_UNIT,
    limit: str | None = None,
) -> DataFrame:
    """Daily read of one series: measure, volume and averages, prices in base units."""
    averages = [f"EMA{s}" for s in spans]
    rows = series_range(
        df, key, value, start, end, [measure, "volume", *averages], limit=limit
    )
    return rows if factor == 1 else scaled(rows, [measure, *averages], factor)


def monthly_price_range(
    df: DataFrame,
    key: str,
    value: str,
    start: str,
    end: str,
    spans: Sequence[int] = (12, 26),
    measure: str = "close",
    factor: float = PRICE_UNIT,
    limit: str | None = None,
) -> DataFrame:
    """Monthly read of one series; rows of the same time are averaged and volumes added."""
    start, end = guards.limited_range(start, end, limit)
    averages = [f"EMA{s}" for s in spans]
    return (
        df.where((F.col(key) == value) & guards.in_range(F.col("time"), start, end))
        .groupBy("time")
        .agg(
            (F.avg(measure) * factor).alias(measure),
            F.sum("volume").alias("volume"),
            *[(F.avg(a) * factor).alias(a) for a in averages],
        )
        .orderBy("time")
    )


def available(df: DataFrame, *columns: str) -> DataFrame:
    """Ordered list of the distinct series names."""
    return df.select(*columns).distinct().orderBy(*columns)


def latest_per_channel(df: DataFrame, channel: str, time: str) -> DataFrame:
    """High-water mark: newest time per channel."""
    return df.groupBy(channel).agg(F.max(time).alias("latest"))


# -- resampling ---------------------------------------------------------------


def _last(column: str, time: str) -> Column:
    """Last non-null value of the group."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(time)))


def _first(column: str, time: str) -> Column:
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(time)))


def month_end_last(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], empty_months: bool = False
) -> DataFrame:
    """One row per key and month, stamped with the month end, holding the last values."""
    bars = df.groupBy(*keys, F.last_day(F.col(time)).alias(time)).agg(
        *[_last(c, time).alias(c) for c in columns]
    )
    return with_empty_months(bars, keys, time) if empty_months else bars


def month_end_bars(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    prices: Mapping[str, str] | None = None,
    empty_months: bool = False,
) -> DataFrame:
    """Monthly open, high, low, close and volume."""
    p = {c: c for c in ("open", "high", "low", "close", "volume")} | dict(prices or {})
    bars = df.groupBy(*keys, F.last_day(F.col(time)).alias(time)).agg(
        _first(p["open"], time).alias("open"),
        F.max(p["high"]).alias("high"),
        F.min(p["low"]).alias("low"),
        _last(p["close"], time).alias("close"),
        F.sum(p["volume"]).alias("volume"),
    )
    return with_empty_months(bars, keys, time) if empty_months else bars


def month_end_mean(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]
) -> DataFrame:
    return df.groupBy(*keys, F.last_day(F.col(time)).alias(time)).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def with_empty_months(bars: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Add a row with null measures for each month without data inside a series.

    A row brings the months between it and the next of its series, so the rows are read once.
    """
    keys = list(keys)
    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    first, last = F.add_months(F.trunc(time, "month"), 1), F.add_months(F.trunc("__after", "month"), -1)
    none = F.array().cast("array<date>")
    gaps = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(none)
    kind = {f.name: f.dataType for f in bars.schema.fields}
    empty = F.transform(
        gaps,
        lambda m: F.struct(
            *[
                (F.col(c) if c in keys else F.last_day(m) if c == time else F.lit(None)).cast(kind[c]).alias(c)
                for c in bars.columns
            ]
        ),
    )
    rows = bars.where(F.col(time).isNotNull()).withColumn("__after", after)
    return rows.select(F.inline(F.concat(F.array(F.struct(*bars.columns)), empty))).select(bars.columns)


def quarter_end_prices(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Monthly rows of the quarter-end months by (year, quarter); the fourth quarter also
    stands for the year (quarter 0)."""
    month, q = F.month(time), F.quarter(time)
    periods = F.when(q == 4, F.array(F.lit(4), F.lit(0))).otherwise(F.array(q))
    return df.where(month % 3 == 0).select(
        key, F.year(time).alias("year"), F.explode(periods).alias("quarter"), *columns
    )


# -- period statistics ----------------------------------------------------------


def with_returns(
    df: DataFrame,
    key: str,
    time: str = "time",
    value: str = "close",
    warmup_from: str | None = None,
    start: str | None = None,
) -> DataFrame:
    """Add ``prev_close`` and ``daily_return``.

    Rows from ``warmup_from`` feed the previous value; rows before ``start``
    are dropped only after that.
    """
    rows = df if warmup_from is None else df.where(F.col(time) >= F.lit(warmup_from).cast("date"))
    rows = previous_value(rows, [key], time, value, "prev_close")
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(start).cast("date"))
    return rows.withColumn("daily_return", measures.growth(F.col(value), F.col("prev_close")))


def _statistics(time: str, value: str) -> list[Column]:
    return [
        F.avg(value).alias("mean_close"),
        F.stddev_samp(value).alias("std_close"),
        F.stddev_samp("daily_return").alias("std_daily_return"),
        F.count(time).alias("duration"),
        F.max_by(value, time).alias("q_close"),
        F.min_by("prev_close", time).alias("start_close"),
    ]


def period_statistics(
    returns: DataFrame, key: str, period: str, time: str = "time", value: str = "close"
) -> DataFrame:
    """Statistics per series, year and ``period`` (quarter or month)."""
    part = {"quarter": F.quarter, "month": F.month}[period]
    return (
        returns.groupBy(
            key, F.year(time).alias("year"), part(F.col(time)).alias("time_val")
        )
        .agg(*_statistics(time, value))
        .withColumn("period_type", F.lit(period))
    )


def all_period_statistics(
    returns: DataFrame, key: str, time: str = "time", value: str = "close"
) -> DataFrame:
    """Quarterly and monthly statistics together, from one pass over the returns."""
    periods = F.array(
        F.struct(F.lit("quarter").alias("kind"), F.quarter(time).alias("val")),
        F.struct(F.lit("month").alias("kind"), F.month(time).alias("val")),
    )
    both = returns.withColumn("p", F.explode(periods))
    return both.groupBy(
        key,
        F.year(time).alias("year"),
        F.col("p.val").alias("time_val"),
        F.col("p.kind").alias("period_type"),
    ).agg(*_statistics(time, value))


def period_close_change(
    df: DataFrame, keys: Sequence[str], time: str, value: str
) -> DataFrame:
    """Last value per quarter and its percent change from the series' previous quarter present."""
    closes = df.groupBy(
        *keys, F.year(time).alias("year"), F.quarter(time).alias("quarter")
    ).agg(F.max_by(value, time).alias("q_close"), F.max(time).alias("__at"))
    changed = previous_value(closes, keys, "__at", "q_close", "prev_close", bucket="year")
    return (
        changed.where(F.col("prev_close").isNotNull())
        .withColumn("increase_pct", measures.percent_change(F.col("q_close"), F.col("prev_close")))
        .drop("__at")
    )
