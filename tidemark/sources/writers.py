"""Writing tables, files and processing marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.sources.workspace import through_table


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def loadable(df: DataFrame, schema: T.StructType, unused: Sequence[str] = ()) -> DataFrame:
    """Rows ready for a table: required columns not null, columns and types as stated."""
    kept = df.drop(*unused).dropna(subset=schemas.required_columns(schema))
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, path: str, schema: T.StructType, unused: Sequence[str] = ()) -> None:
    loadable(df, schema, unused).write.mode("append").parquet(path)


def to_month_table(
    df: DataFrame, path: str, time: str, cluster: Sequence[str], mode: str = "append"
) -> None:
    """Table with one folder per month, rows sorted by the clustering columns inside each file.

    A month is spread over as many tasks as hold its rows; no month has to
    pass through a single task.
    """
    rows = df.withColumn("month", F.date_format(F.col(time), "yyyy-MM"))
    spread = rows.repartitionByRange(F.col("month"), *[F.col(c) for c in cluster], F.col(time))
    spread.sortWithinPartitions("month", *cluster, time).write.mode(mode).partitionBy(
        "month"
    ).parquet(path)


def month_table_range(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Read a range of a month table so that folders outside it are not listed or opened."""
    return df.where(
        F.col("month").between(start[:7], end[:7])
        & F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    )


def append_documents(df: DataFrame, path: str) -> None:
    """Append articles with creation and update times; duplicates are allowed."""
    stamped = df.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    stamped.write.mode("append").parquet(path)


def to_split_json(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """JSON lines, one folder per split."""
    df.write.mode(mode).partitionBy(split).json(path)


def mark_processed(df: DataFrame, path: str, key: str = "url") -> None:
    """Append the keys of processed rows to a table; readers leave them out by anti-join."""
    df.select(key).distinct().withColumn("processed_at", F.current_timestamp()).write.mode(
        "append"
    ).parquet(path)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of columns, nulls equal to nulls."""
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[c])
    return same


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str]) -> None:
    """Put the rows of ``new`` over those of equal ``keys`` in a table with a folder per ``partition``.

    Only partitions in which a row is new or differs are written (dynamic partition overwrite);
    the files of all others stay, and a call that changes nothing writes nothing. The rows of a
    touched partition are merged into a table of their own first, so a failed write can be run
    again. A key stands once in ``new`` and in the table, and keeps its partition; null keys are
    equal to each other.
    """
    spark, names = new.sparkSession, new.columns
    old = spark.read.schema(new.schema).parquet(path).select(names)
    fresh = through_table(new, "upsert-rows")
    changed = fresh.join(old, _same(fresh, old, names), "left_anti")
    touched = through_table(changed.select(*partition).distinct(), "upsert-partitions")
    if touched.isEmpty():
        return
    if not set(partition) <= set(keys):
        moved = _same(fresh, old, keys) & ~_same(fresh, old, partition)
        if not fresh.join(old, moved, "left_semi").isEmpty():
            raise ValueError("a key would move to another partition")
    kept = old.join(touched, _same(old, touched, partition), "left_semi")
    mine = fresh.join(touched, _same(fresh, touched, partition), "left_semi")
    merged = kept.join(mine, _same(kept, mine, keys), "left_anti").unionByName(mine)
    write = through_table(merged, "upsert-merged").write.mode("overwrite").partitionBy(*partition)
    write.option("partitionOverwriteMode", "dynamic").parquet(path)


def set_flag(
    done: DataFrame, path: str, schema: T.StructType, key: str, flag: str, partition: Sequence[str]
) -> None:
    """Set ``flag`` on the stored rows whose ``key`` is in ``done``; other partitions stay untouched."""
    rows = done.sparkSession.read.schema(schema).parquet(path)
    waiting = rows.where(~F.coalesce(F.col(flag), F.lit(False))).join(done.select(key).distinct(), key, "left_semi")
    upsert_partitions(waiting.select(schema.names).withColumn(flag, F.lit(True)), path, [key], partition)
