"""The range and search tools as SQL table functions, with defaults and an as-of limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_TOO_LATE = "Invalid date range: start date is after the limit time."
_REVERSED = "Invalid date range: end date is before start date."
_WORDS = r"array_distinct(filter(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), w -> w != ''))"
_FIRST = "DATE'1900-01-01'"


def _start(limit: str) -> str:
    """The argument ``first``, checked: a broken range is an error, not an empty result."""
    return f"""CASE WHEN first > {limit} THEN CAST(raise_error('{_TOO_LATE}') AS DATE)
          WHEN least(last, {limit}) < first THEN CAST(raise_error('{_REVERSED}') AS DATE) ELSE first END"""


def _ranges(limit: str) -> dict[str, str]:
    end = f"least(last, {limit})"

    def series(table: str, key: str, measures: str) -> str:
        return f"""SELECT CAST(time AS DATE), {measures} FROM {table}
        WHERE {table}.{key} = wanted AND time >= {_start(limit)} AND time <= {end}"""

    def scaled(*spans: int) -> str:
        return ", ".join(f"EMA{s} * 1000" for s in spans)

    day = f"wanted STRING, first DATE DEFAULT {_FIRST}, last DATE DEFAULT {limit}"
    # (year, quarter) as one number, in the order of time.
    period = "(year({0}) * 10 + quarter({0}))"
    return {
        "stock_range": f"""({day}) RETURNS TABLE(time DATE, close DOUBLE, volume BIGINT, EMA20 DOUBLE, EMA50 DOUBLE, EMA200 DOUBLE)
        RETURN {series('tool_stocks', 'stock_code', 'close * 1000, volume, ' + scaled(20, 50, 200))}""",
        "index_range": f"""({day}) RETURNS TABLE(time DATE, close DOUBLE, volume BIGINT, EMA20 DOUBLE, EMA50 DOUBLE)
        RETURN {series('tool_indices', 'index_name', 'close, volume, EMA20, EMA50')}""",
        "commodity_range": f"""({day}) RETURNS TABLE(time DATE, value DOUBLE, volume BIGINT, EMA20 DOUBLE, EMA50 DOUBLE)
        RETURN {series('tool_commodities', 'indicator_name', 'value, volume, EMA20, EMA50')}""",
        "statement_range": f"""(wanted STRING, account STRING, first DATE DEFAULT {_FIRST}, last DATE DEFAULT {limit},
            duration STRING DEFAULT 'quarter') RETURNS TABLE(year INT, quarter INT, data DOUBLE)
        RETURN SELECT year, quarter, data FROM tool_statements
        WHERE stock_code = wanted AND category_code = account AND (
          (duration = 'year' AND quarter = 0 AND year BETWEEN year({_start(limit)}) AND year({end})) OR
          (duration = 'quarter' AND quarter <> 0 AND year * 10 + quarter BETWEEN {period.format(_start(limit))} AND {period.format(end)}))""",
        "news_search": f"""(wanted STRING, first DATE DEFAULT {_FIRST}, last DATE DEFAULT {limit}, most INT DEFAULT 5)
        RETURNS TABLE(url STRING, title STRING, source STRING, pub_date TIMESTAMP_NTZ, score INT)
        RETURN SELECT url, title, source, pub_date, score FROM (
          SELECT *, row_number() OVER (ORDER BY score DESC, pub_date DESC, url) AS place FROM (
            SELECT url, title, source, CAST(pub_date AS TIMESTAMP_NTZ) AS pub_date,
              if(size(array_except({_WORDS.format(text='wanted')}, {_WORDS.format(text='title')})) = 0, 2, 0)
              + if(size(array_except({_WORDS.format(text='wanted')}, {_WORDS.format(text='text')})) = 0, 1, 0) AS score
            FROM tool_news WHERE size({_WORDS.format(text='wanted')}) > 0
              AND pub_date >= {_start(limit)} AND pub_date <= {end}
              AND size(array_except({_WORDS.format(text='wanted')}, {_WORDS.format(text="concat_ws(' ', title, text)")})) = 0))
        WHERE place <= most""",
    }


#: Views the functions read, by the name of the table given to ``register_tools``.
_READS = {
    "stocks": ("stock_range",),
    "indices": ("index_range",),
    "commodities": ("commodity_range",),
    "statements": ("statement_range",),
    "news": ("news_search",),
}


def register_tools(spark: SparkSession, tables: Mapping[str, DataFrame], limit: str) -> list[str]:
    """Make SQL table functions over ``tables``; no function returns anything after ``limit``.

    Tables are any of stocks, indices, commodities (daily series with their averages), statements
    and news. The functions are temporary ones of the session: ``stock_range(code, first, last)``,
    ``index_range(name, …)``, ``commodity_range(name, …)``, ``statement_range(code, account, first,
    last, duration)`` and ``news_search(words, first, last, most)``. Ranges default to all days up to the
    limit; a last day beyond it is clamped, a first day beyond it or after the last is an error.
    They stay SQL, so filters and columns reach the scans. Result: the functions' names.
    """
    day = f"DATE'{limit}'"
    made = []
    for name, table in tables.items():
        table.createOrReplaceTempView(f"tool_{name}")
        for function in _READS[name]:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}{_ranges(day)[function]}")
            made.append(function)
    return made
