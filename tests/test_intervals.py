import datetime as dt

import pytest

from tidemark.operators.intervals import requested_rows

REQUESTS = "id long, key string, a string, b string, asked string, close string"


def day(text):
    return dt.date.fromisoformat(text)


def brute(requests, facts):
    out = []
    for i, key, a, b, asked, _ in requests:
        def parsed(x):
            try:
                return day(x)
            except (TypeError, ValueError):
                return None

        last = min([d for d in (parsed(b), parsed(asked)) if d] or [dt.date.max])
        for k, time, value in facts:
            if k == key and key is not None and time and (parsed(a) or dt.date.min) <= time <= last:
                out.append((i, time, value))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_each_request_gets_its_range(spark, width):
    facts = [("x", day("2024-01-01") + dt.timedelta(days=i), float(i)) for i in range(0, 120, 3)]
    facts += [("y", day("2024-02-29"), 1.0), ("y", day("2024-02-29"), 2.0), ("y", None, 3.0), (None, day("2024-02-01"), 4.0)]
    requests = [
        (1, "x", "2024-01-04", "2024-02-01", "2024-03-01", "c"),
        (2, "x", "2024-01-04", "2024-04-01", "2024-01-10", "c"),  # cut at the day it was asked
        (3, "x", "2024-03-04", "2024-04-01", "2024-03-01", "c"),  # starts after it
        (4, "x", "2024-03-04", "2024-02-01", "2024-05-01", "c"),  # ends before it starts
        (5, "x", "1900-01-01", "2900-01-01", "2899-01-01", "c"),
        (6, "y", "2024-02-29", "2024-02-29", "2024-02-29", "c"),
        (7, "x", "earliest", "latest", "2024-02-01", "c"),
        (8, "x", None, None, None, None),
        (9, None, "2024-01-01", "2024-12-31", "2024-12-31", "c"),
        (9, "y", "2024-01-01", "2024-12-31", "2024-12-31", "c"),
        (10, "z", "2024-01-01", "2024-12-31", "2024-12-31", "c"),
    ]
    asked = spark.createDataFrame(requests, REQUESTS)
    table = spark.createDataFrame(facts, "key string, time date, value double")
    found = requested_rows(asked, table, "key", "time", "a", "b", "asked", ["value"], width)
    assert found.columns == ["id", "key", "a", "b", "asked", "close", "time", "value"]
    assert sorted((r.id, r.time, r.value) for r in found.collect()) == brute(requests, facts)
    assert requested_rows(asked, table.limit(0), "key", "time", "a", "b", "asked", ["value"]).collect() == []


def test_join_has_equal_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(1, "x", "2024-01-04", "2024-02-01", "2024-03-01", "c")], REQUESTS)
        table = spark.createDataFrame([("x", day("2024-01-05"), 1.0)], "key string, time date, value double")
        found = requested_rows(asked, table, "key", "time", "a", "b", "asked", ["value"])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [key" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
