"""Incremental ingest of news with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

_AT, _FILE, _MARK = "__at", "__file", "__mark"
#: Rows of a batch between Spark and its Python workers. A worker holds a batch several times
#: over, and articles have kilobytes each, so Spark's usual 10,000 rows would take gigabytes.
BATCH_ROWS = 500
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, fmt: str = "parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def _write_batch(df: DataFrame, target: str, batch: int) -> None:
    # A batch that is run again replaces its own folder.
    df.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def _newest_times(marked: DataFrame, channel: str) -> DataFrame:
    """The newest ``_AT`` of each channel in each file of a batch, once per task that reads of it."""
    rows = marked.select(channel, _AT, F.col("_metadata.file_path").alias(_FILE))

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            schema = batch.schema
            part = pa.Table.from_batches([batch]).group_by([channel, _FILE]).aggregate([(_AT, "max")])
            for *place, at in zip(*(part[c].to_pylist() for c in (channel, _FILE, f"{_AT}_max")), strict=True):
                known = found.setdefault(tuple(place), at)
                if at is not None and (known is None or at > known):
                    found[tuple(place)] = at
        if found:
            columns = zip(*((name, at, file) for (name, file), at in found.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(newest, rows.schema)


def _through_marks(
    marked: DataFrame, channel: str, answer: Callable[[pd.DataFrame, int | None], pd.DataFrame], output: T.StructType
) -> DataFrame:
    """``answer`` of each channel's rows and its mark, the newest ``_AT`` of the earlier batches."""

    def take(
        key: tuple[str | None], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        newest = mark
        for rows in batches:
            at = rows[_AT]
            yield answer(rows, mark)
            if key[0] is not None and at.notna().any():
                newest = max(int(at.max()), newest if newest is not None else int(at.max()))
        if newest is not None:
            state.update((newest,))

    return marked.groupBy(channel).applyInPandasWithState(take, output, "newest long", "append", "NoTimeout")


def high_water_ingest(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    channel: str = "channel_name",
    time: str = "pub_date",
    again: Callable[[list[str]], DataFrame] | None = None,
) -> StreamingQuery:
    """Append what is strictly newer than the newest item of its channel so far.

    As a consequence an article that arrives late is not taken. Spark's state store keeps one
    row per channel, the newest time of the earlier batches; a batch reads its own files and
    the states of its channels, whatever came before. A batch that is run again finds the state
    it began with, and its rows are written once. Rows without a channel have no state and
    are always taken; rows without a time only until their channel has one.

    Without ``again`` a channel's rows of one batch are one group, whose rows one task sorts and
    sends to its Python worker, ``BATCH_ROWS`` at a time, and the file sink writes them. Few
    channels with many rows need ``again``, which reads files of the stream, given their paths,
    with all their rows. Then only the newest times of each channel and file meet the state, and
    the files of the batch are read once more beside the marks of its channels, so articles are
    neither shuffled nor sent to Python. What is taken lies in a folder of the batch's number
    then, which a batch that is run again replaces. A checkpoint and its target stay with one
    of both ways.
    """
    schema, names = stream.schema, stream.schema.names
    # Microseconds, so that no time zone takes part in a comparison.
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    marked = stream.withColumn(_AT, micros)

    def newer(rows: pd.DataFrame, mark: int | None) -> pd.DataFrame:
        return rows[names] if mark is None else rows.loc[rows[_AT].notna() & (rows[_AT] > mark), names]

    def told(rows: pd.DataFrame, mark: int | None) -> pd.DataFrame:
        return rows[[channel, _FILE]].assign(**{_MARK: mark})

    def take(batch: DataFrame, number: int) -> None:
        spark, found = stream.sparkSession, f"{checkpoint}-marks/batch={number}"
        batch.write.mode("overwrite").parquet(found)
        stored = spark.read.schema(batch.schema).parquet(found)
        files = [unquote(r[_FILE]) for r in stored.select(_FILE).distinct().collect()]
        marks = stored.where(F.col(_MARK).isNotNull()).select(channel, _MARK).distinct()
        rows = (again(files) if files else spark.createDataFrame([], schema)).join(marks, channel, "left")
        _write_batch(rows.where(F.col(_MARK).isNull() | (micros > F.col(_MARK))).select(names), target, number)

    # A query keeps the settings it is started with; the caller's stay as they are.
    conf = stream.sparkSession.conf
    usual = conf.get(_BATCH_ROWS)
    conf.set(_BATCH_ROWS, str(min(BATCH_ROWS, int(usual)) if int(usual) > 0 else BATCH_ROWS))
    try:
        if again is None:
            return append_stream(_through_marks(marked, channel, newer, schema), target, checkpoint)
        output = T.StructType([schema[channel], T.StructField(_FILE, T.StringType()), T.StructField(_MARK, T.LongType())])
        return _batches(_through_marks(_newest_times(marked, channel), channel, told, output), take, checkpoint)
    finally:
        conf.set(_BATCH_ROWS, usual)


def drain(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Run ``work`` on everything not processed yet, batch by batch, then stop.

    The checkpoint remembers what is done.
    """

    def take(batch: DataFrame, number: int) -> None:
        _write_batch(work(batch), target, number)

    return _batches(stream, take, checkpoint)


def first_arrivals(stream: DataFrame, target: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Append the first arrival of each key, however old it is and however late a repeat comes.

    The state store keeps one row per key taken, without a time limit: a batch is compared with
    the keys it brings and never with event time, so nothing is lost and earlier batches are not
    read again. Rows without a key count as repeats of each other; of repeats within one batch
    any one row is taken. With very many keys the RocksDB provider keeps states on disk.
    """
    return append_stream(stream.dropDuplicates([key]), target, checkpoint)


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _batches(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
