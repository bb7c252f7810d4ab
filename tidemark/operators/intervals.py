"""Rows of many requested date ranges at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET, _FIRST, _LAST = "__bucket", "__first", "__last"


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days)


def requested_rows(
    requests: DataFrame,
    facts: DataFrame,
    key: str,
    time: str,
    start: str,
    end: str,
    asked: str,
    columns: Sequence[str],
    bucket_days: int = 32,
) -> DataFrame:
    """Each request's rows of its series in [start, min(end, asked)]: what was known when it asked.

    ``requests`` and ``facts`` share the column ``key``. Bounds are days; a start or end that is
    no date leaves that side open, and so does a missing ``asked``. Requests whose start lies
    after their end or after ``asked`` have no rows, and neither has a series without facts.

    Ranges are cut into buckets of ``bucket_days``, within the days the facts span, and meet the
    facts by series and bucket, so the join has equal keys however long a range is, a hot series
    is spread over its buckets, and a row meets a request once. Result: the columns of
    ``requests``, ``time`` and ``columns``.
    """
    day = F.to_date(F.col(time))
    known = facts.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    low, high = (F.lit(known[c]).cast("date") for c in ("low", "high"))
    limit = F.to_date(F.col(asked))
    # least and greatest leave nulls aside: an open side takes the other bound.
    first = F.greatest(F.try_to_date(F.col(start).cast("string")), low)
    last = F.least(F.try_to_date(F.col(end).cast("string")), limit, high)
    cut = requests.withColumns({_FIRST: first, _LAST: last}).where(F.col(_FIRST) <= F.col(_LAST))
    buckets = F.sequence(_bucket(F.col(_FIRST), bucket_days), _bucket(F.col(_LAST), bucket_days))
    cut = cut.withColumn(_BUCKET, F.explode(buckets))
    rows = facts.select(key, time, *columns, _bucket(day, bucket_days).alias(_BUCKET))
    within = (F.col(time) >= F.col(_FIRST)) & (F.col(time) <= F.col(_LAST))
    return cut.join(rows, [key, _BUCKET]).where(within).select(*requests.columns, time, *columns)
