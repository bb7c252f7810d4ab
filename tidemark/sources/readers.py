"""Reading facts, dimensions, records and parameterised queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_bad"


def facts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet with a stated schema, so no footer is read to find it out."""
    return spark.read.schema(schema).parquet(path)


def dimension(
    spark: SparkSession, path: str, schema: T.StructType | str, trimmed: Sequence[str] = ()
) -> DataFrame:
    """CSV with a header; the columns in ``trimmed`` lose surrounding blanks."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: F.trim(F.col(c)) for c in trimmed}) if trimmed else df


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a line that is not a JSON object of the schema is kept whole in ``_bad``.

    Blank lines are skipped.
    """
    tolerant = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    lines = raw_lines(spark, path)
    record = F.from_json("value", tolerant, options)
    is_object = F.startswith(F.trim("value"), F.lit("{"))
    rows = lines.select("value", F.when(is_object, record).alias("r"))
    bad = F.when(is_object, F.col("r")[_BAD]).otherwise(F.col("value"))
    return rows.select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], bad.alias(_BAD))


def good_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col(_BAD).isNull()).drop(_BAD)


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: lines kept and skipped."""
    bad = F.col(_BAD).isNotNull()
    return lines.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("skipped"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank text lines in a column ``value``."""
    return spark.read.text(path).where(F.trim("value") != "")


def query(
    spark: SparkSession, text: str, parameters: Mapping[str, object] | None = None, **tables: DataFrame
) -> DataFrame:
    """SQL with named parameters (``:name``) over the frames given as ``{table}``."""
    return spark.sql(text, args=dict(parameters or {}), **tables)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``modified`` and ``length`` of all files under ``path``; no file is opened."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("length"),
    )


def latest_files(
    spark: SparkSession, path: str, schema: T.StructType | str, entity_pattern: str, fmt: str = "parquet"
) -> DataFrame:
    """Rows of the newest file of each entity; the entity is group 1 of the file name pattern.

    The newest are chosen from the listing, so older files are never opened. Files of the same
    time are told apart by their name. A path per entity comes to the driver, which holds the
    listing of every read anyway.
    """
    entity: Column = F.regexp_extract("path", entity_pattern, 1)
    newest = file_listing(spark, path).groupBy(entity.alias("entity")).agg(
        F.max_by("path", F.struct("modified", "path")).alias("path")
    )
    paths = sorted(unquote(r["path"]) for r in newest.collect())
    if not paths:
        return spark.createDataFrame([], spark.read.schema(schema).format(fmt).load(path).schema).withColumn("entity", F.lit(""))
    rows = spark.read.schema(schema).format(fmt).load(paths)
    return rows.select("*", F.regexp_extract("_metadata.file_path", entity_pattern, 1).alias("entity"))


def messages(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Records with a list of messages, from JSON lines or parquet."""
    return spark.read.schema(schema).format(fmt).load(path)
