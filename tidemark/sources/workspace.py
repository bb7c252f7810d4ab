"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    ``spark.checkpoint.dir`` names it. A temporary folder is used only for a
    local master; a cluster without the setting is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.gettempdir()
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder nobody else writes to (not created here)."""
    return f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def through_table(df, label: str, partition_by: Sequence[str] = ()):
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("error").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own limit of buckets a table.
MOST_BUCKETS = 100_000


def through_buckets(df, label: str, key: str, buckets: int):
    """Write ``df`` bucketed by ``key`` and read it back.

    Joins, groupings and cogroups by ``key`` then take the stored rows as they are and move only
    the other side. The table is an external one of the session's catalog, in the shared folder.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = max(1, min(buckets, MOST_BUCKETS))
    df.write.mode("error").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)
