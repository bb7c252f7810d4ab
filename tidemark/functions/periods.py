"""Fiscal periods and dates.

``quarter`` is 0 for the annual figure of a year and 1-4 otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(year: Column, quarter: Column) -> Column:
    """Consecutive number of a quarter, so the previous quarter is one less."""
    return year * 4 + quarter - 1


def parse_period(label: Column) -> Column:
    """``"Q4/2024"`` -> (4, 2024); ``"2024"`` -> (0, 2024)."""
    quarter = F.regexp_extract(label, r"^Q(\d)/", 1)
    year = F.regexp_extract(label, r"(\d+)$", 1)
    return F.struct(
        F.coalesce(quarter.try_cast("int"), F.lit(0)).alias("quarter"),
        year.try_cast("int").alias("year"),
    )


def period_stamp(year: Column, quarter: Column) -> Column:
    """The 30th of the period's last month; the annual figure counts as December."""
    month = F.when(quarter == 0, 12).otherwise(quarter * 3)
    return F.make_date(year, month, F.lit(30))


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def ask_date(target_end: Column, gap_months: Column) -> Column:
    """Step back ``gap_months`` and snap to the month end."""
    return F.last_day(F.add_months(target_end, -gap_months))


def year_label_date(label: Column) -> Column:
    """``"YR2018"`` -> 2018-01-01."""
    return F.make_date(F.regexp_replace(label, "YR", "").try_cast("int"), F.lit(1), F.lit(1))


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970, the wall-clock time taken as UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, moment.cast("timestamp_ntz"))


def article_time(text: Column) -> Column:
    """Parse ``"24-07-2024 - 15:20 PM"``; the clock is 24-hour and AM/PM has no effect."""
    stamp = F.regexp_extract(text, r"^(\d{2}-\d{2}-\d{4} - \d{2}:\d{2}) (?:AM|PM|am|pm)$", 1)
    return F.try_to_timestamp(stamp, F.lit("dd-MM-yyyy - HH:mm"))
