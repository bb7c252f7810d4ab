"""Series queries: range reads, resampling, period statistics, averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import measures, periods
from tidemark.operators import guards, intervals, series, sql_tools
from tidemark.operators.continued import append_averages
from tidemark.operators.ordered import moving_averages, previous_value
from tidemark.plans import statement_tables
from tidemark.plans.registry import query
from tidemark.sources.workspace import new_folder

KEY = "series_key"


def rounded(df, *columns, digits=0):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day(column="time"):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def dated(df, column="time"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


DAY = "strftime(time, '%Y-%m-%d') AS time"


# -- range reads ------------------------------------------------------------------


@query(
    "flt1",
    f"""SELECT {DAY}, close * 1000 AS close, volume, round("EMA20" * 1000, 0) AS "EMA20",
        round("EMA50" * 1000, 0) AS "EMA50", round("EMA200" * 1000, 0) AS "EMA200"
    FROM stock_daily WHERE series_key = '1-URGENT' AND time BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "stock_daily",
)
def flt1(t):
    """Daily range of one series with its averages, never past the limit date."""
    rows = series.price_range(
        t.stock_daily_of("1-URGENT"), KEY, "1-URGENT", "1996-01-01", "2001-12-31", limit="2000-12-31"
    )
    return dated(rounded(rows, "EMA20", "EMA50", "EMA200"))


@query(
    "flt1_sql",
    f"""SELECT {DAY}, close * 1000 AS close, volume, round("EMA20" * 1000, 0) AS "EMA20",
        round("EMA50" * 1000, 0) AS "EMA50", round("EMA200" * 1000, 0) AS "EMA200"
    FROM stock_daily WHERE series_key = '1-URGENT' AND time BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "stock_daily",
)
def flt1_sql(t):
    """The same by the SQL table function."""
    sql_tools.register_tools(t.spark, {"stocks": t.stock_daily.withColumnRenamed(KEY, "stock_code")}, "2000-12-31")
    rows = t.spark.sql("SELECT * FROM stock_range('1-URGENT', DATE'1996-01-01', DATE'2001-12-31')")
    return dated(rounded(rows, "EMA20", "EMA50", "EMA200"))


@query(
    "flt2",
    f"""SELECT 'daily' AS duration, {DAY}, close, CAST(volume AS BIGINT) AS volume,
        round("EMA20", 0) AS a, round("EMA50", 0) AS b FROM stock_daily
    WHERE series_key = '3-MEDIUM' AND time BETWEEN DATE '1997-02-01' AND DATE '1999-06-30'
    UNION ALL SELECT 'monthly', {DAY}, close, volume, round("EMA12", 0), round("EMA26", 0)
    FROM stock_monthly
    WHERE series_key = '3-MEDIUM' AND time BETWEEN DATE '1997-02-01' AND DATE '1999-06-30'""",
    "stock_daily stock_monthly",
)
def flt2(t):
    """Index range, daily and monthly."""
    span = ("1997-02-01", "1999-06-30")
    key = "3-MEDIUM"
    daily = series.price_range(t.stock_daily_of(key), KEY, key, *span, spans=(20, 50), factor=1)
    monthly = series.monthly_price_range(t.stock_monthly_of(key), KEY, key, *span, factor=1)
    daily = daily.select(
        F.lit("daily").alias("duration"), day(), "close", "volume",
        F.round("EMA20").alias("a"), F.round("EMA50").alias("b"),
    )
    monthly = monthly.select(
        F.lit("monthly").alias("duration"), day(), "close", "volume",
        F.round("EMA12").alias("a"), F.round("EMA26").alias("b"),
    )
    return daily.unionByName(monthly)


@query(
    "flt3",
    f"""SELECT {DAY}, close AS value, volume, round("EMA20", 3) AS "EMA20", round("EMA50", 3) AS "EMA50"
    FROM commodity_daily WHERE indicator_name = 'Click' AND time BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""",
    "commodity_daily",
)
def flt3(t):
    """Commodity range by name."""
    # The name is known before the averages, so it reaches the scans.
    table = statement_tables.commodity_table(t.commodity.where(F.col("indicator_name") == "Click"))
    rows = series.price_range(
        table, "indicator_name", "Click", "2024-01-03", "2024-01-25", spans=(20, 50),
        measure="value", factor=1,
    )
    return dated(rounded(rows, "EMA20", "EMA50", digits=3))


@query(
    "flt3_monthly",
    f"""SELECT {DAY}, close AS value, volume, round("EMA12", 3) AS "EMA12", round("EMA26", 3) AS "EMA26"
    FROM commodity_monthly WHERE indicator_name = 'Click' AND time BETWEEN DATE '2024-01-03' AND DATE '2024-12-31'""",
    "commodity_monthly",
)
def flt3_monthly(t):
    """Commodity range by name, a row per month."""
    table = statement_tables.commodity_table(t.commodity.where(F.col("indicator_name") == "Click"), "monthly")
    rows = series.monthly_price_range(
        table, "indicator_name", "Click", "2024-01-03", "2024-12-31", measure="value", factor=1
    )
    return dated(rounded(rows, "EMA12", "EMA26", digits=3))


@query(
    "flt4",
    f"SELECT series_key, {DAY}, close * 1000 AS close, open * 1000 AS open FROM bars",
    "bars",
)
def flt4(t):
    """Prices in base units."""
    return dated(series.scaled(t.bars.select(KEY, "time", "close", "open"), ["close", "open"]))


@query(
    "flt5",
    f"SELECT series_key, {DAY}, close FROM bars WHERE time BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'",
    "bars",
)
def flt5(t):
    """All series in a range clamped to a limit date."""
    start, end = guards.limited_range("1995-06-01", "2030-01-01", "1999-12-31")
    return dated(t.bars.where(guards.in_range(F.col("time"), start, end)).select(KEY, "time", "close"))


@query(
    "flt6",
    """SELECT event_id, start_date, time_asked,
        CASE WHEN try_cast(end_date AS DATE) > CAST(time_asked AS DATE) THEN time_asked ELSE end_date END AS end_date,
        CAST(start_date AS DATE) <= CAST(time_asked AS DATE) AS allowed FROM requests""",
    "requests",
)
def flt6(t):
    """Requests checked against the date they were asked."""
    return guards.guarded_requests(t.requests, "start_date", "end_date", "time_asked")


@query(
    "flt6_rows",
    """SELECT event_id, event_type AS indicator_code, time_asked, strftime(time, '%Y-%m-%d') AS time, close, volume
    FROM requests JOIN events USING (event_id) JOIN commodity ON indicator_code = event_type
      AND time >= CAST(start_date AS DATE) AND time <= CAST(time_asked AS DATE)
      AND time <= coalesce(try_cast(end_date AS DATE), DATE '9999-12-31')""",
    "requests commodity",
)
def flt6_rows(t):
    """Every request's rows of its series, never past the day it was asked."""
    series_of = t["events"].select("event_id", F.col("event_type").alias("indicator_code"))
    rows = intervals.requested_rows(
        t.requests.join(series_of, "event_id"), t.commodity, "indicator_code", "time",
        "start_date", "end_date", "time_asked", ["close", "volume"],
    )
    return dated(rows.select("event_id", "indicator_code", "time_asked", "time", "close", "volume"))


@query(
    "agg5",
    f"""SELECT series_key, {DAY}, avg(close) * 1000 AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM months GROUP BY series_key, time""",
    "months",
)
def agg5(t):
    """Monthly read of every series, rows of one time averaged."""
    monthly = series.month_end_last(t.bars, [KEY], "time", ["close", "volume"])
    rows = monthly.groupBy(KEY, "time").agg(
        (F.avg("close") * series.PRICE_UNIT).alias("close"), F.sum("volume").alias("volume")
    )
    return dated(rows)


_RETURNS = """
    SELECT * FROM (
      SELECT series_key, time, close, prev_close, (close - prev_close) / nullif(prev_close, 0) AS daily_return
      FROM (SELECT *, lag(close) OVER (PARTITION BY series_key ORDER BY time) AS prev_close
            FROM bars WHERE time >= DATE '1995-12-01'))
    WHERE time >= DATE '1996-01-01'"""

_STATS = """SELECT series_key, CAST(year(time) AS INTEGER) AS year, CAST({p}(time) AS INTEGER) AS time_val,
    '{p}' AS period_type, avg(close) AS mean_close, round(stddev_samp(close), 2) AS std_close,
    round(stddev_samp(daily_return), 8) AS std_daily_return, count(time) AS duration,
    arg_max(close, time) AS q_close, arg_min(prev_close, time) AS start_close
    FROM returns GROUP BY ALL"""


def returns(t):
    return series.with_returns(
        t.bars.select(KEY, "time", "close"), KEY, warmup_from="1995-12-01", start="1996-01-01"
    )


def tidy_statistics(df):
    return df.withColumns(
        {
            "std_close": F.round("std_close", 2),
            "std_daily_return": F.round("std_daily_return", 8),
        }
    )


@query(
    "agg6",
    _STATS.format(p="quarter") + " ORDER BY series_key, year, time_val",
    "bars",
    {"returns": _RETURNS},
)
def agg6(t):
    """Quarterly statistics per series."""
    stats = tidy_statistics(series.period_statistics(returns(t), KEY, "quarter"))
    return stats.orderBy(KEY, "year", "time_val")


@query(
    "agg7",
    _STATS.format(p="quarter") + " UNION ALL " + _STATS.format(p="month"),
    "bars",
    {"returns": _RETURNS},
)
def agg7(t):
    """Quarterly and monthly statistics together."""
    return tidy_statistics(series.all_period_statistics(returns(t), KEY))


@query(
    "agg8",
    """SELECT indicator_code, strftime(last_day(m), '%Y-%m-%d') AS time, close, volume
    FROM (SELECT indicator_code, unnest(generate_series(date_trunc('month', min(time)), date_trunc('month', max(time)), INTERVAL 1 MONTH)) AS m
      FROM gaps GROUP BY indicator_code)
    LEFT JOIN (SELECT indicator_code, date_trunc('month', time) AS m, arg_max(close, time) AS close,
      arg_max(volume, time) AS volume FROM gaps GROUP BY ALL) USING (indicator_code, m)""",
    "",
    {
        "gaps": """SELECT o_custkey AS indicator_code, CAST(o_orderdate AS DATE) AS time,
            arg_max(round(o_totalprice * 100), o_orderkey) AS close, count(*) AS volume
            FROM orders GROUP BY ALL"""
    },
)
def agg8(t):
    """Last values of each month per customer, the many months without an order kept as rows."""
    rows = (
        t["orders"]
        .groupBy(F.col("o_custkey").alias("indicator_code"), F.to_date("o_orderdate").alias("time"))
        .agg(
            F.max_by(F.round(F.col("o_totalprice") * 100), "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )
    return dated(
        series.month_end_last(rows, ["indicator_code"], "time", ["close", "volume"], empty_months=True)
    )


@query(
    "agg9",
    """SELECT series_key, strftime(last_day(time), '%Y-%m-%d') AS time, arg_min(open, time) AS open, max(high) AS high,
        min(low) AS low, arg_max(close, time) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM bars GROUP BY series_key, last_day(time)""",
    "bars",
)
def agg9(t):
    """Monthly open, high, low, close and volume."""
    return dated(series.month_end_bars(t.bars, [KEY], "time"))


@query(
    "agg10",
    """SELECT series_key, strftime(last_day(time), '%Y-%m-%d') AS time, avg(close) AS close
    FROM bars GROUP BY series_key, last_day(time)""",
    "bars",
)
def agg10(t):
    """Monthly means."""
    return dated(series.month_end_mean(t.bars, [KEY], "time", ["close"]))


@query("agg11", "SELECT DISTINCT series_key FROM bars ORDER BY 1", "bars")
def agg11(t):
    """Available series."""
    return series.available(t.bars, KEY)


@query(
    "agg12",
    """SELECT channel_name, strftime(max(pub_date), '%Y-%m-%d %H:%M:%S') AS latest FROM news GROUP BY 1""",
    "news",
)
def agg12(t):
    """Newest article per channel."""
    marks = series.latest_per_channel(t.news, "channel_name", "pub_date")
    return marks.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


# -- windows -----------------------------------------------------------------------


@query(
    "win1",
    f"""SELECT series_key, {DAY}, close,
        lag(close) OVER (PARTITION BY series_key ORDER BY time) AS prev_close FROM bars""",
    "bars",
)
def win1(t):
    """Previous close."""
    rows = previous_value(t.bars.select(KEY, "time", "close"), [KEY], "time", "close", "prev_close")
    return dated(rows)


@query(
    "win2",
    f"SELECT series_key, {DAY}, close, prev_close, daily_return FROM returns",
    "bars",
    {"returns": _RETURNS},
)
def win2(t):
    """Daily returns after a month of warm-up."""
    return dated(returns(t))


@query(
    "win3",
    """SELECT DISTINCT country, indicator_name, CAST(year(datetime) AS INTEGER) AS year,
        CAST(quarter(datetime) AS INTEGER) AS quarter,
        last_value(value) OVER (PARTITION BY country, indicator_name, year(datetime), quarter(datetime)
          ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS q_close
    FROM macro""",
    "macro",
)
def win3(t):
    """Last value of each quarter per indicator and country."""
    return t.macro.groupBy(
        "country", "indicator_name", F.year("datetime").alias("year"), F.quarter("datetime").alias("quarter")
    ).agg(F.max_by("value", "datetime").alias("q_close"))


_CHANGES = """
    SELECT * FROM (
      SELECT *, lag(q_close) OVER (PARTITION BY country, indicator_name ORDER BY year, quarter) AS prev_close
      FROM (SELECT country, indicator_name, CAST(year(datetime) AS INTEGER) AS year,
              CAST(quarter(datetime) AS INTEGER) AS quarter, arg_max(value, datetime) AS q_close
            FROM macro GROUP BY ALL))
    WHERE prev_close IS NOT NULL"""


@query(
    "win4",
    "SELECT *, (q_close - prev_close) / nullif(prev_close, 0) * 100 AS increase_pct FROM changes",
    "macro",
    {"changes": _CHANGES},
)
def win4(t):
    """Change from quarter to quarter."""
    return series.period_close_change(t.macro, ["country", "indicator_name"], "datetime", "value")


@query(
    "win12",
    f"""SELECT series_key, {DAY}, close, round("EMA20", 0) AS "EMA20", round("EMA50", 0) AS "EMA50",
        round("EMA200", 0) AS "EMA200" FROM stock_daily""",
    "stock_daily",
)
def win12(t):
    """Exponential averages of every series."""
    rows = moving_averages(
        t.bars.select(KEY, "time", "close"), [KEY], "time", "close", (20, 50, 200)
    )
    return dated(rounded(rows, "EMA20", "EMA50", "EMA200"))


@query(
    "win12_append",
    f"""SELECT series_key, {DAY}, close, round("EMA20", 0) AS "EMA20", round("EMA50", 0) AS "EMA50",
        round("EMA200", 0) AS "EMA200" FROM stock_daily""",
    "stock_daily",
)
def win12_append(t):
    """The same in three parts, each going on from the summary of the part before."""
    path, rows = new_folder(t.spark, "win12"), t.bars.select(KEY, "time", "close")
    borders = ("1994-05-17", "1997-01-01")
    parts = (F.col("time") < borders[0], F.col("time").between(*borders), F.col("time") > borders[1])
    for number, part in enumerate(parts):
        append_averages(t.spark, rows.where(part), path, number, [KEY], "time", "close", (20, 50, 200))
    stored = t.spark.read.parquet(f"{path}/rows").drop("part")
    return dated(rounded(stored, "EMA20", "EMA50", "EMA200"))


@query(
    "win13",
    """SELECT series_key, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
        arg_min(prev_close, time) AS start_close FROM returns GROUP BY ALL""",
    "bars",
    {"returns": _RETURNS},
)
def win13(t):
    """Opening price of each month: the close before its first day."""
    return (
        returns(t)
        .groupBy(KEY, F.year("time").alias("year"), F.month("time").alias("month"))
        .agg(F.min_by("prev_close", "time").alias("start_close"))
    )


# -- order, union, scalars -------------------------------------------------------------


@query("srt1", f"SELECT series_key, {DAY}, close FROM bars ORDER BY series_key, time", "bars")
def srt1(t):
    """Bars in series and time order."""
    return dated(t.bars.select(KEY, "time", "close").orderBy(KEY, "time"))


@query(
    "set1",
    """SELECT 'year' AS grain, series_key, CAST(year(time) AS INTEGER) AS val, count(*) AS n FROM bars GROUP BY ALL
    UNION ALL SELECT 'month', series_key, CAST(month(time) AS INTEGER), count(*) FROM bars GROUP BY ALL""",
    "bars",
)
def set1(t):
    """Two aggregates in one table."""
    by = lambda grain, part: t.bars.groupBy(KEY, part("time").alias("val")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit(grain).alias("grain"), KEY, "val", "n")
    return by("year", F.year).unionByName(by("month", F.month))


@query(
    "scl1",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
        CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""",
)
def scl1(t):
    """Year, quarter and month of a date."""
    d = F.col("o_orderdate")
    return t["orders"].select(
        "o_orderkey", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month")
    )


@query(
    "scl2",
    """SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
        strftime(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)), '%Y-%m-%d') AS quarter_end
    FROM orders""",
)
def scl2(t):
    """Last day of the month and of the quarter."""
    d = F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t["orders"].select(
        "o_orderkey",
        text(periods.month_end(F.year(d), F.month(d))).alias("month_end"),
        text(periods.month_end(F.year(d), F.quarter(d) * 3)).alias("quarter_end"),
    )


@query(
    "scl3",
    """SELECT l_orderkey, l_linenumber, l_quantity, strftime(last_day(
        last_day(l_shipdate) - to_months(CAST(l_linenumber AS INTEGER))), '%Y-%m-%d') AS ask_date FROM lineitem""",
)
def scl3(t):
    """Ask date: so many months before a month end, at a month end."""
    end = F.last_day("l_shipdate")
    return t["lineitem"].select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.date_format(periods.ask_date(end, F.col("l_linenumber")), "yyyy-MM-dd").alias("ask_date"),
    )


@query(
    "scl7",
    """SELECT series_key, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
        round(coalesce(stddev_samp(daily_return) * sqrt(count(time)), 0), 4) AS volatility
    FROM returns GROUP BY ALL""",
    "bars",
    {"returns": _RETURNS},
)
def scl7(t):
    """Volatility per month, rounded; 0 where a month has a single return."""
    stats = series.period_statistics(returns(t), KEY, "month")
    risk = measures.volatility(F.col("std_daily_return"), F.col("duration"))
    return stats.select(
        KEY, "year", F.col("time_val").alias("month"), F.round(risk, 4).alias("volatility")
    )


@query(
    "scl8",
    f"""SELECT series_key, {DAY}, (close - open) / nullif(open, 0) * 100 AS change_pct FROM bars""",
    "bars",
)
def scl8(t):
    """Percent change within the day."""
    change = measures.percent_change(F.col("close"), F.col("open"))
    return t.bars.select(KEY, day(), change.alias("change_pct"))


@query(
    "scl28",
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
        arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1""",
)
def scl28(t):
    """First and last order of each customer."""
    when = F.struct("o_orderdate", "o_orderkey")
    return t["orders"].groupBy("o_custkey").agg(
        F.max_by("o_orderkey", when).alias("last_order"),
        F.min_by("o_orderkey", when).alias("first_order"),
    )


@query(
    "job10",
    """SELECT duration, strftime(time, '%Y-%m-%d') AS time, indicator_code, indicator_name, close AS value, volume,
        round(a, 3) AS a, round(b, 3) AS b
    FROM (SELECT 'daily' AS duration, time, indicator_code, indicator_name, close, volume, "EMA20" AS a, "EMA50" AS b
          FROM commodity_daily
          UNION ALL SELECT 'monthly', time, indicator_code, indicator_name, close, volume, "EMA12", "EMA26"
          FROM commodity_monthly)""",
    "commodity_daily commodity_monthly",
)
def job10(t):
    """Commodity table, daily and monthly with averages."""
    daily = statement_tables.commodity_table(t.commodity, "daily")
    monthly = statement_tables.commodity_table(t.commodity, "monthly")
    pick = lambda df, a, b: df.select(
        "duration", day(), "indicator_code", "indicator_name", "value", "volume",
        F.round(a, 3).alias("a"), F.round(b, 3).alias("b"),
    )
    return pick(daily, "EMA20", "EMA50").unionByName(pick(monthly, "EMA12", "EMA26"))
