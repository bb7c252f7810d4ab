"""Point lookups and searches over dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def one(df: DataFrame, key: str, value, columns: Sequence[str]) -> DataFrame:
    """At most one row with ``key == value``."""
    return df.where(F.col(key) == F.lit(value)).select(*columns).limit(1)


def company_detail(companies: DataFrame, code: str) -> DataFrame:
    """Profile of one company, its text cleaned for display."""
    columns = ["stock_code", "company_name", "combine_profile", "industry", "exchange"]
    row = one(companies, "stock_code", code, [c for c in columns if c in companies.columns])
    if "combine_profile" in row.columns:
        row = row.withColumn("combine_profile", tx.clean_profile(F.col("combine_profile")))
    return row


def similar_companies(companies: DataFrame, code: str, top: int = 5) -> DataFrame:
    """Largest other companies of a company's industry, by issued shares."""
    subject = companies.where(F.col("stock_code") == code).select("industry").limit(1)
    return (
        companies.join(subject, "industry", "left_semi")
        .where(F.col("stock_code") != code)
        .orderBy(F.col("issue_share").desc_nulls_last(), "stock_code")
        .limit(top)
        .select("stock_code", "company_name", "industry", "exchange")
    )


def all_similar_companies(companies: DataFrame, top: int = 5) -> DataFrame:
    """``similar_companies`` for every company.

    The ``top`` others of a company are among the ``top + 1`` of its industry,
    so each industry contributes one short list and no pairs are formed.
    """
    ranked = Window.partitionBy("industry").orderBy(
        F.col("issue_share").desc_nulls_last(), "stock_code"
    )
    leaders = (
        companies.where(F.col("industry").isNotNull())
        .withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= top + 1)
        .groupBy("industry")
        .agg(F.array_sort(F.collect_list(F.struct("place", "stock_code"))).alias("leaders"))
    )
    others = F.slice(
        F.filter("leaders", lambda e: e["stock_code"] != F.col("subject")), 1, top
    )
    return (
        companies.select(F.col("stock_code").alias("subject"), "industry")
        .join(leaders, "industry")
        .select("subject", "industry", F.posexplode(others).alias("i", "peer"))
        .select(
            "subject",
            "industry",
            (F.col("i") + 1).alias("place"),
            F.col("peer.stock_code").alias("peer"),
        )
    )


def search_names(dim: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Dimension rows whose listed columns together hold every query token."""
    joined = F.concat_ws(" ", *columns)
    return dim.where(tx.has_all_words(joined, tx.query_words(query)))


def best_names(
    dim: DataFrame, code: str, name: str, query: str, top: int = 10
) -> DataFrame:
    """The ``top`` names by match score; rows with score 0 fill the list up."""
    return (
        dim.select(code, name, tx.name_match_score(F.col(name), query).alias("score"))
        .orderBy(F.col("score").desc(), code)
        .limit(top)
    )


def suggestions(requested: DataFrame, dim: DataFrame, code: str, name: str) -> DataFrame:
    """For requested codes that do not exist: codes whose code or name holds all their tokens.

    What grows with the dimension is joined by sorted rows: its files are far smaller than its
    tokens, so that Spark by itself would send all of them to each task.
    """
    missing = requested.select(F.col(code).alias("requested")).distinct().join(
        dim.select(F.col(code).alias("requested")).hint("merge"), "requested", "left_anti"
    )
    wanted = missing.withColumn("words", tx.tokens(F.col("requested")))
    known = dim.select(code, name, tx.tokens(F.concat_ws(" ", code, name)).alias("tokens"))
    by_token = known.select("*", F.explode("tokens").alias("token"))
    # Only the rarest word of a request is looked up; the others are checked on what it finds.
    frequency = by_token.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.select("requested", "words", F.explode("words").alias("token"))
        .join(frequency.hint("merge"), "token", "left")
        .groupBy("requested", "words")
        .agg(F.min_by("token", F.coalesce("n", F.lit(0))).alias("token"))
    )
    return (
        by_token.hint("merge")
        .join(rarest, "token")
        .where(F.size(F.array_except("words", "tokens")) == 0)
        .select("requested", code, name)
    )
