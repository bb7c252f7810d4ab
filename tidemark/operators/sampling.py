"""Deterministic sampling and shuffling by a seeded hash of a unique id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import hash_bucket, hash_order, numbered


def sample(df: DataFrame, identity: Column, n: int, seed: int | str = 0) -> DataFrame:
    """Exactly ``n`` rows (all rows if there are fewer), uniformly chosen.

    Rows are numbered by hash range, so ``n`` may be large without meeting in one task.
    """
    rows = df.withColumn("__h", hash_order(identity, seed))
    ranked = numbered(rows, [], [F.col("__h")], hash_bucket(F.col("__h")), "__i")
    return ranked.where(F.col("__i") <= n).drop("__h", "__i")


def shuffled(df: DataFrame, identity: Column, seed: int | str = 0) -> DataFrame:
    return df.orderBy(hash_order(identity, seed))


def quota_sample(
    df: DataFrame,
    identity: Column,
    is_entity: Column,
    is_preferred: Column,
    quota: int,
    seed: int | str = 0,
) -> DataFrame:
    """All rows without an entity plus ``quota`` entity rows, preferred entities first."""
    rows = df.withColumns(
        {
            "__entity": F.coalesce(is_entity, F.lit(False)),
            "__rank": F.when(F.coalesce(is_preferred, F.lit(False)), "0").otherwise("1"),
            "__h": hash_order(identity, seed),
        }
    )
    ranked = numbered(
        rows.where("__entity"),
        [],
        [F.col("__rank"), F.col("__h")],
        F.concat("__rank", hash_bucket(F.col("__h"))),
        "__i",
    )
    chosen = ranked.where(F.col("__i") <= quota).drop("__i")
    return rows.where(~F.col("__entity")).unionByName(chosen).drop("__entity", "__rank", "__h")
