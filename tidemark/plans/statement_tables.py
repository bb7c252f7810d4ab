"""Jobs that build the statement tables and their dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import growth, ordered, series
from tidemark.operators import statements as st


def cleaned_statements(raw: DataFrame, segment: str, first_year: int = 2010) -> DataFrame:
    """Raw rows ``(stock_code, category_code, time, data)`` -> dated facts of one segment.

    The first row per entity, account and period label counts (in the order of
    the values), derived accounts are added, old years and empty values go.
    """
    rows = st.first_per_key(raw, ["stock_code", "category_code", "time"], ["data"])
    facts = st.labelled(st.with_period(rows), segment=segment)
    for name, (added, subtracted) in st.DERIVED_ACCOUNTS.get(segment, {}).items():
        facts = st.derived_account(facts, name, added, subtracted)
    return st.drop_empty(st.from_year(facts, first_year), "data")


def universal_statements(facts_by_segment: Mapping[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """Segment facts under universal codes, in one table; unmapped accounts drop out."""
    own = {"corp": "corp_code", "bank": "bank_code", "securities": "sec_code"}
    parts = [
        st.to_universal(facts, mapping, own[segment], keep_unmapped=False)
        for segment, facts in facts_by_segment.items()
    ]
    return st.drop_empty(st.stacked(*parts), "stock_code", "data")


def merged_notes(parts: Sequence[DataFrame]) -> DataFrame:
    return st.stacked(*parts)


def with_trailing_rows(facts: DataFrame, calendar: bool = True) -> DataFrame:
    """Facts plus trailing-twelve-month rows of the eligible income and cash-flow accounts.

    The facts are read once: the trailing sum stands beside each row and becomes a row after it.
    """
    code, names = F.col("category_code"), facts.columns
    chosen = F.coalesce(st.ttm_candidates(code), F.lit(False)) & (F.col("quarter") != 0)
    sums = growth.trailing_sum(F.col("data"), growth.run_window("category_code"), calendar)
    rows = facts.withColumn("__ttm", sums).withColumn("__ttm", F.when(chosen, F.col("__ttm")))
    trailing = {"category_code": F.concat(code, F.lit("_TTM")), "data": F.col("__ttm")}
    own = F.struct(*names)
    added = F.struct(*[trailing.get(c, F.col(c)).alias(c) for c in names])
    both = F.when(F.col("__ttm").isNull(), F.array(own)).otherwise(F.array(own, added))
    return rows.select(F.inline(both)).select(names)


def account_dimension(standard: DataFrame, notes: DataFrame) -> DataFrame:
    """Code dimension: standard captions plus de-duplicated note captions."""
    unique = st.first_per_key(
        notes.where(F.col("en_caption").isNotNull()).select("category_code", "en_caption"),
        ["category_code"],
        ["en_caption"],
    )
    named = unique.select(
        "category_code",
        F.concat(F.lit(st.CAPTION_PREFIX["notes"]), "en_caption").alias("category_name"),
    )
    return standard.where(F.col("category_code").isNotNull()).unionByName(named)


def company_universe(
    base: Mapping[str, DataFrame], extension: Mapping[str, DataFrame] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Segment tables (extended when asked) and a row of distinct company counts per segment."""
    tables = {
        segment: st.stacked(df, extension[segment]) if extension and segment in extension else df
        for segment, df in base.items()
    }
    labelled = [
        df.select("stock_code", F.lit(segment).alias("segment")) for segment, df in tables.items()
    ]
    counts = (
        st.stacked(*labelled)
        .groupBy("segment")
        .agg(F.countDistinct("stock_code").alias("companies"))
    )
    return tables, counts


def macro_from_wide(
    wide: DataFrame,
    indicator: str,
    divisor: float = 1.0,
    unit: str = "Percentage",
    country: str = "country",
) -> DataFrame:
    """One column per year (``YR2018``) -> long macro rows dated January 1st."""
    years = [c for c in wide.columns if c != country]
    long = wide.unpivot([country], years, "label", "value")
    return long.select(
        periods.year_label_date(F.col("label")).alias("datetime"),
        F.lit("annually").alias("duration"),
        F.lit(indicator).alias("indicator_name"),
        F.col(country).alias("country"),
        (F.col("value") / F.lit(divisor)).alias("value"),
        F.lit(unit).alias("unit"),
    )


# Yield column -> indicator name.
YIELD_NAMES = {"2Y": "USA_2Y", "10Y": "USA_10Y"}


def yields_from_wide(
    wide: DataFrame, time: str, names: Mapping[str, str] = YIELD_NAMES, country: str = "USA"
) -> DataFrame:
    """One column per maturity -> long macro rows of monthly yields."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    long = wide.unpivot([time], list(names), "maturity", "value")
    return long.select(
        F.col(time).alias("datetime"),
        F.lit("monthly").alias("duration"),
        F.element_at(lookup, F.col("maturity")).alias("indicator_name"),
        F.lit(country).alias("country"),
        "value",
        F.lit("Percentage").alias("unit"),
    )


def commodity_table(
    daily: DataFrame, duration: str = "daily", key: str = "indicator_code"
) -> DataFrame:
    """Long commodity rows with averages: daily (20, 50) or month-end (12, 26)."""
    if duration == "monthly":
        bars = series.month_end_bars(daily, [key, "indicator_name"], "time", empty_months=False)
        spans, bucket = (12, 26), "year"
    else:
        bars, spans, bucket = daily, (20, 50), "year"
    rows = bars.select(
        "time",
        F.lit(duration).alias("duration"),
        key,
        "indicator_name",
        F.col("close").alias("value"),
        "volume",
    )
    return ordered.moving_averages(rows, [key], "time", "value", spans, bucket=bucket)


def price_rows(daily: DataFrame, key: str, value: str = "close", factor: float = series.PRICE_UNIT) -> DataFrame:
    """Quarter-end prices in base units from daily bars."""
    monthly = series.month_end_last(daily, [key], "time", [value])
    rows = series.quarter_end_prices(monthly, key, "time", [value])
    return rows.withColumn(value, F.col(value) * F.lit(factor))


