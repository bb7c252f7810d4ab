"""Moving averages that go on from a stored summary, without the rows before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import moving_averages, numbered

_LAST, _OLD = "__last", "__old"


def last_averages(averaged: DataFrame, keys: Sequence[str], time: str, names: Sequence[str]) -> DataFrame:
    """The summary: per series the newest time with averages, and those averages."""
    known = averaged.where(F.col(names[0]).isNotNull())
    newest = known.groupBy(*keys).agg(
        F.max(time).alias(_LAST), F.max_by(F.struct(*names), time).alias("__averages")
    )
    return newest.select(*keys, _LAST, *(F.col(f"__averages.{n}").alias(n) for n in names))


def continued_averages(
    rows: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    spans: Sequence[int],
    prefix: str = "EMA",
    bucket: str = "year",
) -> DataFrame:
    """Averages of ``rows``, all later than their series' ``summary``, as if nothing had been cut.

    The recurrence is linear: a series goes on as if from zero, by a row of value 0 at the end of
    its summary, and the stored average is added with the weight left of it, q^n at the n-th new
    row. A series without a summary begins with its first value. Rows with a null value take no
    part and get a null average.
    """
    keys, names = list(keys), [f"{prefix}{s}" for s in spans]
    new = rows.withColumn(_OLD, F.lit(False))
    zero = summary.select(*keys, F.col(_LAST).alias(time), F.lit(0.0).alias(value), F.lit(True).alias(_OLD))
    both = new.unionByName(zero, allowMissingColumns=True)
    local = moving_averages(both, keys, time, value, spans, prefix, bucket).where(~F.col(_OLD)).drop(_OLD)
    known = local.where(F.col(value).isNotNull())
    known = numbered(known, keys, [F.col(time)], F.date_trunc(bucket, time), "__place")
    carried = summary.select(*keys, *(F.col(n).alias(f"__{n}") for n in names))
    met = known.join(carried, keys, "left")
    added = {
        n: F.col(n) + F.coalesce(F.pow(F.lit(1.0 - 2.0 / (s + 1.0)), "__place") * F.col(f"__{n}"), F.lit(0.0))
        for n, s in zip(names, spans)
    }
    return met.withColumns(added).select(local.columns).unionByName(local.where(F.col(value).isNull()))


def append_averages(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    number: int,
    keys: Sequence[str],
    time: str,
    value: str,
    spans: Sequence[int],
    prefix: str = "EMA",
    bucket: str = "year",
) -> None:
    """Write the averages of the ``number``-th part of a table (from 0), and the summary after it.

    Part ``number`` reads its own rows and the summary of the part before it, one row per series;
    stored rows are not read. Parts go to ``path/rows/part=n`` and ``path/summary/part=n``, so a
    part that is run again replaces itself. A row that is not later than its series' summary is
    an error: it would change averages already written.
    """
    keys, names = list(keys), [f"{prefix}{s}" for s in spans]
    if number == 0:
        averaged = moving_averages(rows, keys, time, value, spans, prefix, bucket)
        before = None
    else:
        before = spark.read.parquet(f"{path}/summary/part={number - 1}")
        early = rows.join(before, keys).where(F.col(time) <= F.col(_LAST))
        if not early.isEmpty():
            raise ValueError(f"rows not later than the summary: {early.select(*keys, time).first()}")
        averaged = continued_averages(rows, before, keys, time, value, spans, prefix, bucket)
    averaged.write.mode("overwrite").parquet(f"{path}/rows/part={number}")
    written = spark.read.parquet(f"{path}/rows/part={number}")
    summary = last_averages(written, keys, time, names)
    if before is not None:
        summary = before.join(summary, keys, "left_anti").unionByName(summary)
    summary.write.mode("overwrite").parquet(f"{path}/summary/part={number}")
