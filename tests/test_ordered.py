import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, series


@pytest.fixture(scope="module")
def walk(spark):
    """One series with most of the rows, gaps in time, missing values, and two short ones."""
    rng = np.random.default_rng(5)
    frames = []
    for key, n in (("hot", 2500), ("cold", 40), ("one", 1)):
        days = pd.Series(pd.date_range("2001-01-01", periods=n * 2)).sample(n, random_state=1).sort_values()
        values = 100 + rng.normal(size=n).cumsum()
        frames.append(pd.DataFrame({"key": key, "time": days.dt.date.values, "x": values}))
    return pd.concat(frames, ignore_index=True)


def as_spark(spark, pdf):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, time date, x double").repartition(5)


@pytest.mark.parametrize("bucket", ["day", "month", "year"])
def test_previous_value(spark, walk, bucket):
    got = ordered.previous_value(as_spark(spark, walk), ["key"], "time", "x", "prev", bucket).toPandas()
    got = got.sort_values(["key", "time"]).reset_index(drop=True)
    want = walk.sort_values(["key", "time"]).reset_index(drop=True)
    pd.testing.assert_series_equal(got["prev"], want.groupby("key")["x"].shift(1).rename("prev"))


@pytest.mark.parametrize("bucket,block", [("month", 7), ("year", 16), ("year", 256)])
def test_moving_averages(spark, walk, bucket, block):
    df = as_spark(spark, walk)
    got = ordered.moving_averages(df, ["key"], "time", "x", (12, 200), bucket=bucket, block=block)
    got = got.toPandas().sort_values(["key", "time"]).reset_index(drop=True)
    want = walk.sort_values(["key", "time"]).reset_index(drop=True)
    for span in (12, 200):
        expected = want.groupby("key")["x"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(got[f"EMA{span}"], expected, rtol=1e-11)


def test_missing_values_take_no_part(spark, walk):
    holes = walk.copy()
    holes.loc[holes.index % 5 == 0, "x"] = np.nan
    got = ordered.moving_averages(as_spark(spark, holes), ["key"], "time", "x", (20,), bucket="month", block=8)
    got = got.toPandas().sort_values(["key", "time"]).reset_index(drop=True)
    full = holes.dropna(subset=["x"]).sort_values(["key", "time"])
    full["e"] = full.groupby("key")["x"].transform(lambda s: s.ewm(span=20, adjust=False).mean())
    merged = got.merge(full[["key", "time", "e"]], on=["key", "time"], how="left")
    assert len(got) == len(holes)
    np.testing.assert_allclose(merged["EMA20"], merged["e"], rtol=1e-11)


def test_constant_series_has_constant_average(spark):
    rows = [("a", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), 7.5) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, time date, x double")
    got = ordered.moving_averages(df, ["key"], "time", "x", (50,))
    low, high = got.agg(F.min("EMA50"), F.max("EMA50")).first()
    assert low == pytest.approx(7.5, abs=1e-12) and high == pytest.approx(7.5, abs=1e-12)


def test_numbered_is_consecutive_and_in_order(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"))
    digest = ordered.hash_order(F.col("id"), 4)
    got = ordered.numbered(df, ["g"], [digest], ordered.hash_bucket(digest), "n").withColumn("h", digest).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("h")
        assert part["n"].tolist() == list(range(1, len(part) + 1))


def test_empty_months_are_rows(spark):
    rows = [("a", datetime.date(2020, 1, 5), 1.0), ("a", datetime.date(2020, 1, 9), None), ("a", datetime.date(2020, 4, 2), 3.0)]
    df = spark.createDataFrame(rows, "k string, time date, close double")
    got = series.month_end_last(df, ["k"], "time", ["close"], empty_months=True).orderBy("time").collect()
    assert [(r["time"].isoformat(), r["close"]) for r in got] == [
        ("2020-01-31", 1.0),
        ("2020-02-29", None),
        ("2020-03-31", None),
        ("2020-04-30", 3.0),
    ]
