import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.continued import append_averages, continued_averages
from tidemark.operators.ordered import moving_averages

SPANS = (3, 20, 200)
SCHEMA = "k string, t date, x double, note string"


def series():
    """Three series of different length, gaps and nulls; one has no value at first, one begins late."""
    rng, day = random.Random(6), dt.date(2020, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), rng.uniform(10, 90), "n") for i in range(900) if i % 7]
    rows += [("b", day + dt.timedelta(days=i), None if i < 40 or i % 5 == 0 else rng.uniform(-5, 5), "n") for i in range(700)]
    return rows + [("c", day + dt.timedelta(days=i), 1e6 + i, None) for i in range(610, 620)]


def averages(df):
    return {(r.k, r.t): tuple(r[f"EMA{s}"] for s in SPANS) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert all((x is None) == (y is None) for x, y in zip(got[key], values)), key
        assert got[key] == pytest.approx(values, rel=1e-12) if values[0] is not None else True, key


@pytest.mark.parametrize("bucket", ["year", "day"])
def test_parts_equal_the_whole(spark, tmp_path, bucket):
    rows, path = spark.createDataFrame(series(), SCHEMA), str(tmp_path / "s")
    borders = [dt.date(2019, 1, 1), dt.date(2020, 1, 21), dt.date(2021, 6, 1), dt.date(2021, 9, 11), dt.date(2030, 1, 1)]
    for n, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
        part = rows.where((F.col("t") >= F.lit(a)) & (F.col("t") < F.lit(b)))
        for _ in range(2 if n == 2 else 1):  # a part may be run again
            append_averages(spark, part, path, n, ["k"], "t", "x", SPANS, bucket=bucket)
    stored = spark.read.parquet(f"{path}/rows").drop("part")
    assert set(stored.columns) == {*rows.columns, *(f"EMA{s}" for s in SPANS)}
    same(averages(stored), averages(moving_averages(rows, ["k"], "t", "x", SPANS)))
    assert spark.read.parquet(f"{path}/summary/part=3").count() == 3


def test_an_append_reads_its_rows_and_one_summary(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame(series(), SCHEMA)
    append_averages(spark, rows.where("t < '2021-08-01'"), path, 0, ["k"], "t", "x", SPANS)
    rows.where("t >= '2021-08-01'").write.parquet(f"{path}/new")
    new, summary = spark.read.parquet(f"{path}/new"), spark.read.parquet(f"{path}/summary/part=0")
    found = continued_averages(new, summary, ["k"], "t", "x", SPANS)
    folders = {f.rsplit("/", 1)[0].removeprefix("file://") for f in found.inputFiles()}
    assert folders == {f"{path}/new", f"{path}/summary/part=0"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{path}/rows" not in plan


def test_rows_before_the_summary_are_an_error(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1.0, "")], SCHEMA)
    append_averages(spark, first, path, 0, ["k"], "t", "x", SPANS)
    for day in (4, 5):
        late = spark.createDataFrame([("a", dt.date(2020, 1, day), 1.0, "")], SCHEMA)
        with pytest.raises(ValueError, match="not later"):
            append_averages(spark, late, path, 1, ["k"], "t", "x", SPANS)
    append_averages(spark, first.limit(0), path, 1, ["k"], "t", "x", SPANS)
    assert spark.read.parquet(f"{path}/summary/part=1").count() == 1
