import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vector_store, vectors
from tidemark.operators.vector_store import build_store, search_store

SCHEMA = "vec_id long, embedding array<float>, at timestamp_ntz, url string"


def unit(v):
    v = np.asarray(v, dtype=np.float64)
    n = np.linalg.norm(v)
    return v / n if n else v


def brute(points, queries, k, start=None, end=None):
    out = {}
    for q, v in queries:
        scored = []
        for key, x, at, url in points:
            if x is None or len(x) != len(v) or any(c is None or not np.isfinite(c) for c in x):
                continue
            if (start and not (at and at >= start)) or (end and not (at and at <= end)):
                continue
            scored.append((-round(float(unit(np.float32(x)) @ unit(np.float32(v))), 9), key, url))
        out[q] = [(key, url, -s) for s, key, url in sorted(scored)[:k]]
    return {q: r for q, r in out.items() if r}


def ours(hits):
    out = {}
    for r in hits.orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.url, round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """40 directions with 120 vectors close to each, times in no relation to them."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16))
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=int(i))
    rows = [
        (i, [float(x) for x in np.float32(middles[i % 40] + rng.normal(size=16) * 0.05)], day(rng.integers(0, 300)), f"u{i % 90}")
        for i in range(4800)
    ]
    queries = [(1000 + i, [float(x) for x in np.float32(middles[i] + rng.normal(size=16) * 0.05)]) for i in range(12)]
    return rows, queries


def test_equals_the_scan_and_skips_parts(spark, clustered):
    rows, queries = clustered
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, vector array<float>")
    store = build_store(df, time="at", payload=["url"], part_rows=32)
    assert store.parts.agg(F.sum("rows")).first()[0] == 4800 and store.parts.count() >= 150
    for start, end in ((None, None), (dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1))):
        hits, report = search_store(store, asked, k=6, start=start, end=end)
        assert ours(hits) == brute(rows, queries, 6, start, end)
        seen = report.collect()
        assert len(seen) == 12 and all(r.opened < 0.25 * r.parts for r in seen)
    whole = vectors.nearest(df, asked.withColumnRenamed("vector", "embedding"), k=6, payload=["url"])
    assert ours(whole) == ours(search_store(store, asked, k=6)[0])


def test_ties_zero_and_unusable_vectors(spark, monkeypatch):
    """Several lots and blocks; equal scores in different parts go by key."""
    for name, value in (("LOT", 3), ("BLOCK", 2), ("MOST_PIVOTS", 4)):
        monkeypatch.setattr(vector_store, name, value)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, [float(i % 3), 1.0, 0.0], at, "a") for i in range(60)]
    rows += [(100 + i, [0.0, 0.0, 0.0], None, "z") for i in range(5)]
    rows += [(200, None, at, "n"), (201, [1.0, None, 0.0], at, "n"), (202, [float("nan"), 0.0, 0.0], at, "n"), (203, [], at, "n")]
    rows += [(300 + i, [1.0, float(i)], at, "short") for i in range(7)] + [(400, [-1.0, -1.0, 0.0], at, "far")]
    queries = [(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0] * 4),
               (6, [-1.0, -1.0, 0.0]), (7, [2.0, 2.0, 0.0])]
    asked = spark.createDataFrame([*queries, (8, None), (9, [float("inf"), 0.0, 0.0])], "query_id long, vector array<float>")
    store = build_store(spark.createDataFrame(rows, SCHEMA).repartition(3), time="at", payload=["url"], part_rows=4)
    for k in (1, 7, 500):
        assert ours(search_store(store, asked, k=k)[0]) == brute(rows, queries, k)
    # Rows without a time are outside any range.
    assert ours(search_store(store, asked, k=500, start=at)[0]) == brute(rows, queries, 500, at)


def test_empty(spark):
    points = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    hits, report = search_store(build_store(points, time="at"), asked)
    assert hits.collect() == [] and [(r.parts, r.opened) for r in report.collect()] == [(0, 0)]


def test_points_are_not_shuffled_by_a_search(spark, clustered, monkeypatch):
    rows, queries = clustered
    store = build_store(spark.createDataFrame(rows[:500], SCHEMA), payload=["url"], part_rows=32)
    asked = spark.createDataFrame(queries, "query_id long, vector array<float>")
    plans = []
    written = vector_store.through_table

    def keep(df, label, *rest):
        if label == "vector-hits":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label, *rest)

    monkeypatch.setattr(vector_store, "through_table", keep)
    search_store(store, asked, k=3)
    assert len(plans) == 2
    for plan in plans:
        assert "Bucketed: true" in plan
        assert all("vector#" not in part.split("\n")[0] for part in plan.split("Exchange ")[1:])
        assert all("vector" not in part for part in plan.split("Exchange ")[1:] if "FileScan" in part and "tidemark_vectors_" in part)
