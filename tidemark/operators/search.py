"""Full-text search over news."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import guards


def search_news(
    news: DataFrame,
    query: str,
    start: str,
    end: str,
    limit: int = 5,
    channel: str | None = None,
    as_of: str | None = None,
    whole_end_day: bool = False,
) -> DataFrame:
    """Best articles holding all query tokens in title and text together.

    A title match counts 2, a text match 1; newer articles come first among
    equals. Without a channel the shortened text is returned too.
    """
    start, end = guards.limited_range(start, end, as_of)
    words = tx.query_words(query)
    rows = news.where(guards.in_range(F.col("pub_date"), start, end, whole_end_day))
    if channel is not None:
        rows = rows.where(F.col("channel_name") == channel)
    rows = rows.where(tx.has_all_words(F.concat_ws(" ", "title", "text"), words))
    scored = rows.withColumn("score", tx.news_match_score(F.col("title"), F.col("text"), words))
    columns = ["url", "title", "source", "pub_date", "score"]
    if channel is None:
        scored = scored.withColumn("text", tx.shorten(F.col("text")))
        columns.append("text")
    return (
        scored.orderBy(F.col("score").desc(), F.col("pub_date").desc(), "url")
        .limit(limit)
        .select(columns)
    )


def token_table(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per document and distinct token: the search table to store."""
    words = tx.tokens(F.concat_ws(" ", *columns))
    return docs.select(key, F.explode(words).alias("token"))


def sorted_tokens(table: DataFrame, key: str) -> DataFrame:
    """The token table in the order to store it: a token's rows lie together, a frequent one's in
    several files, and a search skips the row groups of other tokens."""
    return table.repartitionByRange("token", key).sortWithinPartitions("token", key)


def search_tokens(table: DataFrame, key: str, query: str) -> DataFrame:
    """Documents that hold every query token, from the stored token table.

    The token filter reaches the scan; only matching rows are grouped.
    """
    words = tx.query_words(query)
    return (
        table.where(F.col("token").isin(words))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(words))
        .select(key)
    )


def articles_for_hits(hits: DataFrame, news: DataFrame, length: int = 750) -> DataFrame:
    """Full articles of scored urls, text shortened, score kept."""
    return hits.join(news, "url").withColumn("text", tx.shorten(F.col("text"), length))
