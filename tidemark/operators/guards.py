"""Point-in-time limits on requested date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limited_range(start: str, end: str, limit: str | None = None) -> tuple[str, str]:
    """Clamp ``end`` to ``limit``; reject a start after the limit or an empty range.

    Dates are ISO text. ``limit=None`` means there is no limit.
    """
    if limit is not None:
        if start > limit:
            raise ValueError("Invalid date range: start date is after the limit time.")
        end = min(end, limit)
    if end < start:
        raise ValueError("Invalid date range: end date is before start date.")
    return start, end


def guarded_requests(
    requests: DataFrame, start: str, end: str, asked: str, allowed: str = "allowed"
) -> DataFrame:
    """Column form for many requests: ``end`` is clamped to ``asked``, ``allowed`` tells whether
    the start lies within the data known at that time.

    A bound that is not a date is left as it is and does not forbid the request.
    """
    limit = F.to_date(F.col(asked))
    first, last = F.try_to_date(F.col(start)), F.try_to_date(F.col(end))
    return requests.withColumn(
        allowed, F.coalesce(first <= limit, F.lit(True))
    ).withColumn(
        end, F.when(last > limit, F.date_format(limit, "yyyy-MM-dd")).otherwise(F.col(end))
    )


def in_range(time: Column, start: str, end: str, whole_end_day: bool = False) -> Column:
    """``time BETWEEN start AND end``; an end given as a day means its midnight.

    With ``whole_end_day`` the later hours of the end day count too.
    """
    # Text bounds take the column's own type, so the comparison reaches the scan.
    if whole_end_day:
        return (time >= F.lit(start)) & (time < F.date_add(F.lit(end).cast("date"), 1))
    return time.between(F.lit(start), F.lit(end))
