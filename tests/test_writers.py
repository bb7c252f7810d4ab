import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.sources import readers, writers
from tidemark.sources.workspace import through_buckets

FACTS = "code string, quarter int, data double, year int"


def files(path):
    """Names and times of the data files by partition folder."""
    found = {}
    for f in glob.glob(f"{path}/*/*.parquet"):
        found.setdefault(os.path.basename(os.path.dirname(f)), set()).add((os.path.basename(f), os.stat(f).st_mtime_ns))
    return found


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"c{i % 5}", i % 4, float(i), 2000 + i % 3) for i in range(60)]
    rows = list({(c, q, y): (c, q, d, y) for c, q, d, y in rows}.values()) + [("n", None, 1.0, 2001), ("n", 2, None, None)]
    spark.createDataFrame(rows, FACTS).write.partitionBy("year").parquet(path)
    return path, rows


def stored(spark, path):
    return sorted(map(tuple, spark.read.schema(FACTS).parquet(path).collect()), key=repr)


def test_only_touched_partitions_are_written(spark, table):
    path, rows = table
    before = files(path)
    new = [("c1", 1, 99.0, 2001), ("c0", 0, 0.0, 2000), ("new", 3, 5.0, 2001), ("n", None, 7.0, 2001), ("x", 1, 1.0, 2009)]
    keys = ["code", "quarter", "year"]
    writers.upsert_partitions(spark.createDataFrame(new, FACTS), path, keys, ["year"])
    want = {(c, q, y): (c, q, d, y) for c, q, d, y in rows}
    want |= {(c, q, y): (c, q, d, y) for c, q, d, y in new}
    assert stored(spark, path) == sorted(want.values(), key=repr)
    after = files(path)
    assert {p for p in after if before.get(p) != after[p]} == {"year=2001", "year=2009"}  # 2000 brought what it had
    writers.upsert_partitions(spark.createDataFrame(new, FACTS), path, keys, ["year"])
    assert files(path) == after


def test_rows_without_partition_value_and_moving_keys(spark, table):
    path, rows = table
    writers.upsert_partitions(spark.createDataFrame([("n", 2, 4.0, None)], FACTS), path, ["code", "quarter", "year"], ["year"])
    assert ("n", 2, 4.0, None) in stored(spark, path) and len(stored(spark, path)) == len(rows)
    one = spark.createDataFrame([("n", 2, 4.0, 2002)], FACTS)
    with pytest.raises(ValueError, match="another partition"):
        writers.upsert_partitions(one, path, ["code", "quarter"], ["year"])


def test_flags_are_set_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"u{i}", True if i == 3 else None, f"m{i % 3}") for i in range(12)]
    schema = spark.createDataFrame(rows, "url string, done boolean, month string").schema
    spark.createDataFrame(rows, schema).write.partitionBy("month").parquet(path)
    before = files(path)
    urls = spark.createDataFrame([("u1",), ("u3",), ("u4",), ("u4",), ("elsewhere",), (None,)], "url string")
    writers.set_flag(urls, path, schema, "url", "done", ["month"])
    got = {r.url: r.done for r in spark.read.schema(schema).parquet(path).collect()}
    assert {u for u, d in got.items() if d} == {"u1", "u3", "u4"} and len(got) == 12
    after = files(path)
    assert {p for p in after if before[p] != after[p]} == {"month=m1"}
    writers.set_flag(urls, path, schema, "url", "done", ["month"])
    assert files(path) == after


def test_only_newest_files_are_opened(spark, tmp_path):
    for entity in ("a", "b b"):
        for n in range(4):
            path = tmp_path / f"{entity}_{n}.json"
            path.write_text('{"v": %d}' % n)
            os.utime(path, (1_700_000_000 + (n * 7) % 4, 1_700_000_000 + (n * 7) % 4))
    (tmp_path / "b b_1.json").write_text("not read at all {")
    os.utime(tmp_path / "b b_1.json", (1_600_000_000, 1_600_000_000))
    listing = readers.file_listing(spark, str(tmp_path))
    assert listing.count() == 8 and "content" not in listing._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    found = readers.latest_files(spark, str(tmp_path), "v long", r"/([ab%20]+)_\d\.json", "json")
    assert len(found.inputFiles()) == 2
    assert sorted((r.entity, r.v) for r in found.collect()) == [("a", 1), ("b%20b", 2)]


def test_bucketed_tables_join_without_exchange(spark):
    left = through_buckets(spark.range(1000).selectExpr("id % 90 AS k", "id AS x"), "l", "k", 8)
    right = through_buckets(spark.range(90).selectExpr("id AS k", "id * 2 AS y"), "r", "k", 8)
    joined = left.join(right.hint("merge"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and joined.count() == 1000


def test_checks_and_failing_rows_come_from_the_write(spark, tmp_path):
    rows = [("a", 1.0), ("b", -1.0), ("c", None), (None, -2.0)]
    df = spark.createDataFrame(rows, "code string, data double")
    checks = {"has_code": F.col("code").isNotNull(), "positive": F.col("data") > 0}
    path = str(tmp_path / "x")
    seen, failing = quality.checked_write(df, path, checks, {"least": F.min("data")}, most_failures=3)
    assert seen == {"rows": 4, "failing_rows": 3, "has_code": 1, "positive": 3, "least": -2.0}
    got = {(r.code, r.data): r.failed for r in failing.collect()}
    assert got == {("b", -1.0): ["positive"], ("c", None): ["positive"], (None, -2.0): ["has_code", "positive"]}
    assert spark.read.parquet(f"{path}/passed=true").count() == 1
    with pytest.raises(ValueError, match="3 of 4 rows fail"):
        quality.checked_write(df, str(tmp_path / "y"), checks)
    seen, failing = quality.checked_write(df.limit(0), str(tmp_path / "z"), checks)
    assert seen["rows"] == 0 and failing.collect() == []
