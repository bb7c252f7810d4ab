"""Ordered computations over long series: previous value, moving averages, row numbers.

A series may hold a large share of all rows, so nothing here sorts a whole
series in one task. Rows are cut into calendar buckets, each bucket is handled
on its own, and what crosses a bucket border travels as one summary row per
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _CARRY = "__bucket", "__carry"


def calendar_bucket(time: str, size: str) -> Column:
    """First day of the calendar unit; ``size`` is day, week, month, quarter or year."""
    day = F.to_date(F.col(time))
    return day if size == "day" else F.trunc(day, size)


def _bucketed(df: DataFrame, keys: Sequence[str], time: str, size: str) -> DataFrame:
    """Rows with their bucket. Keys and time are required; rows without them drop out.

    Saying so here keeps the plans of all uses alike, so their exchanges are shared.
    """
    rows = df.withColumn(_BUCKET, calendar_bucket(time, size))
    for column in (*keys, time, _BUCKET):
        rows = rows.where(F.col(column).isNotNull())
    return rows


def previous_value(
    df: DataFrame, keys: Sequence[str], time: str, value: str, out: str, bucket: str = "month"
) -> DataFrame:
    """``lag(value)`` per key in time order."""
    keys = list(keys)
    rows = _bucketed(df, keys, time, bucket)
    borders = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.max_by(value, time).alias("__last"))
        .withColumn(_CARRY, F.lag("__last").over(Window.partitionBy(*keys).orderBy(_BUCKET)))
        .drop("__last")
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(time)
    first = F.row_number().over(inside) == 1
    return (
        rows.withColumns({"__first": first, "__prev": F.lag(value).over(inside)})
        .join(borders, [*keys, _BUCKET])
        .withColumn(out, F.when(F.col("__first"), F.col(_CARRY)).otherwise(F.col("__prev")))
        .drop(_BUCKET, _CARRY, "__first", "__prev")
    )


def moving_averages(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    spans: Sequence[int],
    prefix: str = "EMA",
    bucket: str = "year",
    block: int = 256,
) -> DataFrame:
    """Exponential moving averages ``y = a*x + (1-a)*y_prev`` with ``a = 2/(span+1)``, ``y0 = x0``.

    Rows with a null value take no part and get a null average.

    The recurrence is linear, so each block of rows is averaged from a zero
    start with running sums, and the value carried in from earlier blocks is
    added with its decayed weight. Blocks are short enough that the powers
    stay far from overflow. Only one summary per block is chained. A bucket
    should fit a task: years suit daily bars, days suit intraday rows.
    """
    keys = list(keys)
    decay = {s: 1.0 - 2.0 / (s + 1.0) for s in spans}
    x = F.col(value).cast("double")
    known = F.col(value).isNotNull()

    rows = _bucketed(df, keys, time, bucket)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(time)
    counted = F.count(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__n", F.greatest(counted - 1, F.lit(0))).withColumns(
        {
            "__block": F.floor(F.col("__n") / block).cast("int"),
            "__pos": F.col("__n") % block,
        }
    )
    running = (
        Window.partitionBy(*keys, _BUCKET, "__block")
        .orderBy(time)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def local(q: float) -> Column:
        """Average of the block so far, started from zero."""
        scaled = F.sum(x * F.pow(F.lit(q), -F.col("__pos"))).over(running)
        return F.pow(F.lit(q), F.col("__pos")) * scaled * (1.0 - q)

    rows = rows.withColumns({f"__local{s}": local(q) for s, q in decay.items()})

    at = F.when(known, F.col("__pos"))
    ends = rows.groupBy(*keys, _BUCKET, "__block").agg(
        F.count(value).alias("rows"),
        F.min_by(x, at).alias("first"),
        *[F.max_by(F.col(f"__local{s}"), at).alias(f"end{s}") for s in spans],
    )
    carried = _chain_blocks(ends, keys, decay)

    weight = F.col("__pos") + 1
    rows = rows.join(carried, [*keys, _BUCKET]).withColumn(
        "__in", F.element_at("__carries", F.col("__block") + 1)
    )
    return rows.select(
        *df.columns,
        *[
            F.when(
                known,
                F.col(f"__local{s}") + F.pow(F.lit(q), weight) * F.col("__in")[f"carry{s}"],
            ).alias(f"{prefix}{s}")
            for s, q in decay.items()
        ],
    )


def _chain_blocks(ends: DataFrame, keys: list[str], decay: dict[int, float]) -> DataFrame:
    """Per (key, bucket): array over blocks of the averages that enter each block.

    Blocks are combined inside their bucket first, then whole buckets along the
    series, so an array holds one bucket's blocks or one series' buckets.
    """
    spans = list(decay)

    def averages(of) -> list[Column]:
        return [of(s).alias(f"z{s}") for s in spans]

    def append(seen: Column, item: Column) -> Column:
        return F.concat(seen, F.array(item))

    # Inside a bucket, from a zero start: rows and average before each block.
    zero = F.struct(F.lit(0.0).alias("n"), *averages(lambda s: F.lit(0.0)))

    def next_block(state: Column, block: Column) -> Column:
        now, n = state["now"], block["rows"].cast("double")
        after = F.struct(
            (now["n"] + n).alias("n"),
            *averages(
                lambda s: F.coalesce(block[f"end{s}"], F.lit(0.0))
                + F.pow(F.lit(decay[s]), n) * now[f"z{s}"]
            ),
        )
        return F.struct(after.alias("now"), append(state["seen"], now).alias("seen"))

    item = f"struct<n:double,{','.join(f'z{s}:double' for s in spans)}>"
    start = F.struct(zero.alias("now"), F.array().cast(f"array<{item}>").alias("seen"))
    summary = F.struct("__block", "rows", "first", *[f"end{s}" for s in spans])
    buckets = (
        ends.groupBy(*keys, _BUCKET)
        .agg(F.array_sort(F.collect_list(summary)).alias("__b"))
        .select(
            *keys,
            _BUCKET,
            F.aggregate("__b", start, next_block).alias("__f"),
            _first_known("__b").alias("first"),
        )
        .select(
            *keys,
            _BUCKET,
            F.col("__f.now").alias("total"),
            F.col("__f.seen").alias("before"),
            "first",
        )
    )

    # Along the series: the average that enters each bucket.
    chained = buckets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(_BUCKET).alias("at"), "total", "first"))).alias("__k")
    )
    opening = F.struct(*averages(lambda s: _first_known("__k")))

    def next_bucket(state: Column, part: Column) -> Column:
        now, total = state["now"], part["total"]
        after = F.struct(
            *averages(lambda s: total[f"z{s}"] + F.pow(F.lit(decay[s]), total["n"]) * now[f"z{s}"])
        )
        entry = F.struct(part["at"].alias("at"), now.alias("carry"))
        return F.struct(after.alias("now"), append(state["seen"], entry).alias("seen"))

    carry = f"struct<{','.join(f'z{s}:double' for s in spans)}>"
    nothing = F.array().cast(f"array<struct<at:date,carry:{carry}>>")
    entering = F.aggregate(
        "__k", F.struct(opening.alias("now"), nothing.alias("seen")), next_bucket, lambda x: x["seen"]
    )
    carries = chained.select(*keys, F.inline(entering)).withColumnRenamed("at", _BUCKET)

    def entering_block(before: Column) -> Column:
        return F.struct(
            *[
                (
                    before[f"z{s}"] + F.pow(F.lit(decay[s]), before["n"]) * F.col("carry")[f"z{s}"]
                ).alias(f"carry{s}")
                for s in spans
            ]
        )

    return buckets.join(carries, [*keys, _BUCKET]).select(
        *keys, _BUCKET, F.transform("before", entering_block).alias("__carries")
    )


def _first_known(array: str) -> Column:
    return F.get(F.filter(array, lambda e: e["first"].isNotNull()), F.lit(0))["first"]


def numbered(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str,
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers per group without sorting a whole group in one task.

    ``bucket`` must not decrease along ``order`` and should split a group into
    many small parts (a date, or the leading digits of a hash that leads the
    order). Counts per bucket give each bucket its offset.
    """
    groups = list(groups)
    rows = df.withColumn(_BUCKET, bucket)
    counts = rows.groupBy(*groups, _BUCKET).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy(_BUCKET) if not groups else Window.partitionBy(*groups).orderBy(_BUCKET)
    offsets = counts.select(
        *groups,
        _BUCKET,
        F.coalesce(
            F.sum("__size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
    )
    inside = Window.partitionBy(*groups, _BUCKET).orderBy(*order)
    return (
        rows.withColumn("__n", F.row_number().over(inside))
        .join(offsets, [*groups, _BUCKET], "left")
        .withColumn(out, F.col("__n") + F.col("__offset") + (start - 1))
        .drop(_BUCKET, "__n", "__offset")
    )


def hash_order(identity: Column, seed: int | str = 0) -> Column:
    """Deterministic random order of rows: md5 of the id and a seed."""
    return F.md5(F.concat(identity.cast("string"), F.lit(f":{seed}")))


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    """Leading digits of a hash, a bucket that follows the hash order."""
    return F.substring(digest, 1, digits)
