import hashlib
import math

import numpy as np
import pytest

from tidemark.llm.centroids import Rounds, cluster_vectors, nearest, vantage_tree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, rounds):
    """(id, cluster, distance, centroid, cluster inertia, inertia) in Python integers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == rounds.components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(rounds.scale * float(np.float32(x))) for x in v]))
    name = lambda k: (k is None, hashlib.sha256(f"{rounds.seed}:{k}".encode()).hexdigest() if k is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: rounds.clusters]]
    if not centroids:
        return []

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds.rounds):
        near = assigned()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, i) in zip(kept, near) if i == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assigned()
    per = {c: sum(d for d, i in near if i == c) for c in range(len(centroids))}
    out = [(k, i, d, tuple(centroids[i]), per[i], sum(per.values())) for (k, _), (d, i) in zip(kept, near)]
    return sorted(out, key=repr)


def ours(df, rounds):
    out = cluster_vectors(df, rounds=rounds).collect()
    return sorted(
        ((r.vec_id, r.cluster, r.distance, tuple(r.centroid), r.cluster_inertia, r.inertia) for r in out), key=repr
    )


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = brute(rows, Rounds())
    assert ours(df, Rounds()) == want
    assert len({r[1] for r in want}) > 1


@pytest.mark.parametrize("step", [1.0, 0.25])
def test_ties_repeats_and_odd_rows(spark, step):
    """A coarse grid has many equally near centroids; several first centroids are equal."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) * step]) for i in range(120)]
    rows += rows[:20] + [(None, [1.0, 1.0, 1.0, 1.0]), (None, [0.0, 0.0, 0.0, -1.0])]
    rows += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0])]
    rows += [(905, [float("nan")] * 4), (906, [float("inf"), 0.0, 0.0, 0.0]), (907, [0.0, 0.0, 0.0, float("-inf")])]
    rounds = Rounds(clusters=9, rounds=4, components=4, scale=4)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS v", "'x' AS cluster", "1 AS n", "2 AS c")
    want = brute(rows, rounds)
    assert ours(df.repartition(7), rounds) == want
    assert len(want) == 120 + 20 + 2 + 60


def test_fewer_vectors_than_clusters_and_none(spark):
    rounds = Rounds(clusters=8, rounds=2, components=2)
    rows = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ours(df, rounds) == brute(rows, rounds)
    empty = cluster_vectors(df.limit(0), rounds=rounds)
    assert empty.collect() == []
    assert empty.columns == cluster_vectors(df, rounds=rounds).columns


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0])], SCHEMA)
    with pytest.raises(Exception, match="would not fit"):
        cluster_vectors(df, rounds=Rounds(components=2)).collect()


@pytest.mark.parametrize("k", [1, 2, 8, 200])
def test_tree_finds_the_nearest_and_prunes(k):
    rng = np.random.default_rng(k)
    middles = rng.integers(-5000, 5000, (20, 16))
    near = lambda n: middles[rng.integers(0, 20, n)] + rng.integers(-40, 40, (n, 16))
    centroids, vectors = near(k), near(3000)
    centroids[k // 2] = centroids[0]  # equal centroids: the smaller number
    label, best, looked = nearest(vectors, vantage_tree(centroids.tolist()))
    apart = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (label == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    if k == 200:
        assert looked < 0.4 * apart.size


def test_bounds_are_inclusive():
    """Both centroids lie at the same distance on a line; the smaller number must win in any order."""
    for centroids in ([[0], [10], [20]], [[20], [10], [0]], [[10], [0], [20]]):
        label, best, _ = nearest(np.array([[5], [15], [10]]), vantage_tree(centroids))
        apart = (np.array([[5], [15], [10]]) - np.array(centroids).T) ** 2
        assert label.tolist() == apart.argmin(axis=1).tolist() and best.tolist() == apart.min(axis=1).tolist()
