"""Bars from a stream by event time, with what comes too late kept beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_MERGED = ("newest", "open_time", "open", "high", "low", "close_time", "close", "volume")


def _end(start: Column, unit: str) -> Column:
    return F.timestamp_add(unit.upper(), F.lit(1), start)


def _partial(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Single observations as partial bars; a missing open or close has no time."""
    return _joined(
        rows.select(
            *keys,
            "window",
            F.col(time).alias("newest"),
            F.when(F.col("open").isNotNull(), F.col(time)).alias("open_time"),
            "open",
            "high",
            "low",
            F.when(F.col("close").isNotNull(), F.col(time)).alias("close_time"),
            "close",
            "volume",
        ),
        keys,
    )


def _joined(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial bars of the same key and window as one."""
    return parts.groupBy(*keys, "window").agg(
        F.max("newest").alias("newest"),
        F.min("open_time").alias("open_time"),
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("close_time").alias("close_time"),
        F.max_by("close", "close_time").alias("close"),
        F.sum("volume").alias("volume"),
    )


def _windowed(rows: DataFrame, time: str, unit: str) -> DataFrame:
    return rows.withColumn("window", F.date_trunc(unit, F.col(time)).cast(rows.schema[time].dataType))


def stream_bars(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    time: str = "time",
    unit: str = "month",
    delay: str = "INTERVAL 10 DAYS",
) -> StreamingQuery:
    """Open, high, low, close and volume per key and calendar window, written once a window is over.

    The watermark is the newest event time so far less ``delay``. A window whose end it has
    passed is closed: its bar is appended to ``target/bars``. A row that arrives for a window
    that earlier batches closed, or without time, is appended as it is to ``target/late``, so
    bars and late rows together hold all rows; ``completed_bars`` joins them.

    A batch reads its own files and the windows still open after the batch before it, one
    partial bar per key and window, and pre-aggregates before the shuffle, so a hot series is no
    hot task. All that a batch writes lies in folders of its number, and a batch that is run
    again replaces them. The columns are open, high, low, close and volume beside key and time.
    """
    names = stream.schema.names

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = _windowed(batch, time, unit)
        ends = _end(F.col("window"), unit)
        if number:
            mark = spark.read.parquet(f"{checkpoint}-marks/batch={number - 1}").first()["mark"]
            stored = spark.read.parquet(f"{checkpoint}-windows/batch={number - 1}")
            over = ends <= F.lit(mark) if mark is not None else F.lit(False)
            open_before = stored.where(~over)
        else:
            over, open_before = F.lit(False), None
        too_late = F.coalesce(over, F.lit(True))  # no time, no window
        parts = _partial(rows.where(~too_late & F.col(time).isNotNull()), keys, time)
        if open_before is not None:
            parts = parts.unionByName(open_before)
        _joined(parts, keys).write.mode("overwrite").parquet(f"{checkpoint}-windows/batch={number}")
        windows = spark.read.parquet(f"{checkpoint}-windows/batch={number}")
        late = rows.where(too_late | F.col(time).isNull()).select(names)
        late.write.mode("overwrite").parquet(f"{target}/late/batch={number}")
        newest = windows.agg(F.max(F.col("newest") - F.expr(delay)).alias("mark"))
        if number:
            newest = newest.select(F.greatest("mark", F.lit(mark).cast(newest.schema["mark"].dataType)).alias("mark"))
        newest.write.mode("overwrite").parquet(f"{checkpoint}-marks/batch={number}")
        now = spark.read.parquet(f"{checkpoint}-marks/batch={number}").first()["mark"]
        closed = windows.where(ends <= F.lit(now)) if now is not None else windows.limit(0)
        closed.write.mode("overwrite").parquet(f"{target}/bars/batch={number}")

    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def completed_bars(
    spark: SparkSession, target: str, keys: Sequence[str], time: str = "time", unit: str = "month"
) -> DataFrame:
    """All closed windows with their late rows: key, ``window``, open, high, low, close, volume."""
    bars = spark.read.parquet(f"{target}/bars").select(*keys, "window", *_MERGED)
    late = spark.read.parquet(f"{target}/late").drop("batch")
    more = _partial(_windowed(late.where(F.col(time).isNotNull()), time, unit), keys, time)
    return _joined(bars.unionByName(more), keys).drop("newest", "open_time", "close_time")
