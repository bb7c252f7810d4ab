import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import topk


def brute(rows, asks, k):
    out = []
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in good:
        if asks(q):
            hits = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def ours(df, column, k=5):
    return sorted(map(tuple, topk.top_k(df, column, k=k).select("query_id", "rank", "vec_id", "score").collect()))


def test_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert ours(df, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("block, group", [(30, 5), (400, 100)])
def test_clusters_ties_and_copies(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 6)) * 3
    rows = [(i, (centers[i % 8] + rng.normal(size=6) * 0.05).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a hot vector
    rows += [(2000 + i, np.round(rng.normal(size=6)).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ours(df, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (None, [1.0, 1.0]),
            (50, [1.0, 2.0, 3.0]), (100, [2.0, 2.0]), (6, [2.0, 2.0]), (7, [-1.0, 0.001]), (150, [0.0, 0.0])]
    df = spark.createDataFrame([(a, b, "x", 9) for a, b in rows], "vec_id long, embedding array<double>, block string, score int")
    assert ours(df, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0, 5)
    assert ours(df.limit(0), F.col("vec_id") % 50 == 0) == []
    assert ours(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0) == []
    again = rows + [(6, [2.0, 2.0]), (100, [2.0, 2.0])]
    got = ours(spark.createDataFrame(again, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3)
    assert [r[2:] for r in got] == [(6, 256 * 256 * 6)] * 2 + [(100, 256 * 256 * 6)]


def test_walk_leaves_out_pairs_and_loses_nothing():
    rng = np.random.default_rng(5)
    points = np.concatenate([np.floor(rng.normal(size=(300, 4)) * 5 + c) for c in ([900, 0, 0, 0], [-900, 0, 0, 0], [0, 900, 0, 0])])
    queries = points[::30] + 1
    ids, asked = np.arange(len(points)), -1 - np.arange(len(queries))
    best, seen = topk.Best(asked, 5), []
    offer = best.offer
    best.offer = lambda rows, scores, names: (seen.append(scores.size), offer(rows, scores, names))
    topk.search(queries, asked, points, ids, best)
    scores = queries @ points.T
    want = [sorted((-s, i) for i, s in enumerate(row))[:5] for row in scores.tolist()]
    assert best.hits == want and sum(seen) < scores.size / 2
