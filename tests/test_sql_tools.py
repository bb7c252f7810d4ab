import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, series
from tidemark.operators import statements as st
from tidemark.operators.sql_tools import register_tools

LIMIT = "2020-06-30"


@pytest.fixture(scope="module")
def tools(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(k, day(i), float(i), i, i + 0.5, i + 0.25, i + 0.125) for k in ("MBB", "ACB") for i in range(300)]
    prices = spark.createDataFrame(rows, "k string, time date, close double, volume long, EMA20 double, EMA50 double, EMA200 double")
    facts = [("S1", "BS_1", y, q, float(y * 10 + q)) for y in range(2017, 2022) for q in range(5)]
    news = [(f"u{i}", f"Rates {'fall' if i % 2 else 'rise'}", "s", dt.datetime(2020, 1, 1) + dt.timedelta(days=20 * i), f"the Bank, no {i % 3}")
            for i in range(14)]
    tables = {
        "stocks": prices.withColumnRenamed("k", "stock_code"),
        "indices": prices.withColumnRenamed("k", "index_name"),
        "commodities": prices.withColumnsRenamed({"k": "indicator_name", "close": "value"}),
        "statements": spark.createDataFrame(facts, "stock_code string, category_code string, year int, quarter int, data double"),
        "news": spark.createDataFrame(news, "url string, title string, source string, pub_date timestamp_ntz, text string"),
    }
    names = register_tools(spark, tables, LIMIT)
    assert len(names) == 5
    return tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ranges_equal_the_operators(spark, tools):
    got = spark.sql("SELECT * FROM stock_range('MBB', DATE'2020-02-01', DATE'2020-12-31')")
    want = series.price_range(tools["stocks"], "stock_code", "MBB", "2020-02-01", "2020-12-31", limit=LIMIT)
    assert got.columns == want.columns and rows(got, "time") == rows(want, "time") and got.count() == 151
    got = spark.sql("SELECT * FROM commodity_range('ACB', last => DATE'2020-01-10')")
    want = series.price_range(
        tools["commodities"], "indicator_name", "ACB", "2020-01-01", "2020-01-10", (20, 50), "value", 1, LIMIT
    )
    assert got.columns == want.columns and rows(got, "time") == rows(want, "time")
    assert spark.sql("SELECT * FROM index_range('MBB')").agg(F.max("time")).first()[0] == dt.date(2020, 6, 30)


@pytest.mark.parametrize("duration", ["quarter", "year"])
def test_statements_equal_the_operator(spark, tools, duration):
    got = spark.sql(f"SELECT * FROM statement_range('S1', 'BS_1', DATE'2018-05-10', DATE'2021-01-01', '{duration}')")
    want = st.period_range(tools["statements"], "S1", "category_code", "BS_1", "2018-05-10", "2021-01-01", duration, LIMIT)
    assert rows(got, "year", "quarter") == rows(want) and rows(want)


@pytest.mark.parametrize("words", ["rates FALL", "bank", "the 1", "nothing here", "", "?!"])
def test_search_equals_the_operator(spark, tools, words):
    got = spark.sql("SELECT * FROM news_search(:w, DATE'2020-01-15', DATE'2020-12-31', 3)", args={"w": words})
    want = search.search_news(tools["news"], words, "2020-01-15", "2020-12-31", limit=3, as_of=LIMIT).drop("text")
    assert got.columns == want.columns and sorted(rows(got)) == sorted(rows(want))


def test_broken_ranges_are_errors(spark, tools):
    for call, text in (("'MBB', DATE'2020-07-01'", "after the limit"), ("'MBB', DATE'2020-03-01', DATE'2020-02-01'", "before start")):
        with pytest.raises(Exception, match=text):
            spark.sql(f"SELECT * FROM stock_range({call})").collect()


def test_functions_join_and_push_their_filters(spark, tools, tmp_path):
    path = str(tmp_path / "stocks")
    tools["stocks"].write.parquet(path)
    register_tools(spark, {"stocks": spark.read.parquet(path)}, LIMIT)
    plan = spark.sql("SELECT time, close FROM stock_range('MBB')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stock_code,MBB)" in plan and "EMA200" not in plan.split("ReadSchema")[1]
    lateral = spark.sql(
        "SELECT code, count(*) FROM VALUES ('MBB'), ('ACB'), ('none') AS c(code), LATERAL stock_range(c.code) GROUP BY code"
    )
    assert sorted(map(tuple, lateral.collect())) == [("ACB", 182), ("MBB", 182)]
