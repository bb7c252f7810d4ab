"""Exact Lloyd rounds over integer vectors, nearest centroids found in a vantage-point tree."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors are searched in slices of about so many (vector, centroid) cells.
SLICE_CELLS = 1 << 21


@dataclass(frozen=True)
class Rounds:
    """``clusters`` centroids, moved ``rounds`` times; a component x becomes floor(scale * x)."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: int = 3

    @property
    def largest(self) -> int:
        """Integers up to here have squared distances that fit a long."""
        return int((2**62 / self.components) ** 0.5 / 2)


def vantage_tree(centroids: list[list[int]]) -> dict[str, np.ndarray]:
    """Plain arrays of a vantage-point tree; node 0 is the root, -1 stands for no child.

    A node's point is ``point``. The others of its set are halved by their distance from it
    into child 0 (near) and child 1 (far); ``low`` and ``high`` are each half's least and
    greatest distance.
    """
    data = np.array(centroids, np.int64)
    point, child, low, high = [], [], [], []

    def grow(members: np.ndarray) -> int:
        if not len(members):
            return -1
        node = len(point)
        point.append(members[0])
        for column, blank in ((child, -1), (low, 0.0), (high, 0.0)):
            column.append([blank, blank])
        others = members[1:]
        apart = np.sqrt(((data[others] - data[members[0]]) ** 2).sum(axis=1))
        order = np.argsort(apart, kind="stable")
        half = (len(others) + 1) // 2
        for side, part in enumerate((order[:half], order[half:])):
            if len(part):
                low[node][side], high[node][side] = apart[part].min(), apart[part].max()
                child[node][side] = grow(others[part])
        return node

    grow(np.arange(len(data)))
    return {
        "data": data,
        "point": np.array(point, np.int64),
        "child": np.array(child, np.int64).reshape(-1, 2),
        "low": np.array(low).reshape(-1, 2),
        "high": np.array(high).reshape(-1, 2),
    }


def nearest(vectors: np.ndarray, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, its squared distance, and how many distances that took.

    Every vector has a frontier of its own and goes on with the node of the least lower bound
    (best first). A node is dropped only if its bound lies beyond the best distance by more
    than rounding can: at an equal bound an equally near centroid with a smaller number may
    follow. Distances are exact integers; ties go to the smaller number.
    """
    n, nodes = len(vectors), len(tree["point"])
    bound = np.full((n, nodes), np.inf)
    bound[:, 0] = 0
    best, label = np.full(n, np.iinfo(np.int64).max), np.full(n, nodes)
    looked = 0
    while True:
        chosen = bound.argmin(axis=1)
        least = bound[np.arange(n), chosen]
        # The slack is far above the error of square roots of integers below 2^63.
        open_rows = np.flatnonzero(least <= np.sqrt(best.astype(float)) * (1 + 1e-12) + 1e-6)
        if not len(open_rows):
            return label, best, looked
        for node in np.unique(chosen[open_rows]):
            rows = open_rows[chosen[open_rows] == node]
            looked += len(rows)
            number = tree["point"][node]
            apart = ((vectors[rows] - tree["data"][number]) ** 2).sum(axis=1)
            better = (apart < best[rows]) | ((apart == best[rows]) & (number < label[rows]))
            best[rows[better]], label[rows[better]] = apart[better], number
            away, above = np.sqrt(apart.astype(float)), bound[rows, node]
            bound[rows, node] = np.inf
            for side in (0, 1):
                child = tree["child"][node, side]
                if child >= 0:
                    gap = np.maximum(tree["low"][node, side] - away, away - tree["high"][node, side])
                    bound[rows, child] = np.maximum(above, gap)


def _matrix(column: pa.Array, rounds: Rounds) -> np.ndarray:
    data = column.flatten().to_numpy().reshape(-1, rounds.components)
    if len(data) and max(int(data.max()), -int(data.min())) > rounds.largest:
        raise ValueError(f"a component beyond {rounds.largest / rounds.scale}: squared distances would not fit a long")
    return data


def _searched(data: np.ndarray, tree: dict[str, np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    step = max(1, SLICE_CELLS // len(tree["point"]))
    for a in range(0, len(data), step):
        part = slice(a, a + step)
        label, apart, _ = nearest(data[part], tree)
        yield part, label, apart


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, rounds: Rounds) -> DataFrame:
    """``id`` and ``v``, integers, of vectors with all components present and finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(vector_col) == rounds.components) & whole)
    return kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * rounds.scale)).alias("v"))


def _moved(stored: DataFrame, centroids: list[list[int]], rounds: Rounds) -> list[list[int]]:
    """The floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    tree = stored.sparkSession.sparkContext.broadcast(vantage_tree(centroids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value["data"])
        sums, counts = np.zeros((k, rounds.components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            data = _matrix(batch.column(0), rounds)
            for part, label, _ in _searched(data, tree.value):
                counts += np.bincount(label, minlength=k)
                for c in np.unique(label):
                    sums[c] += data[part][label == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["c", "n", "sums"]
        )

    parts = stored.select("v").mapInArrow(add, "c long, n long, sums array<long>")
    flat = parts.select("c", "n", F.posexplode("sums").alias("at", "x"))
    total = lambda column: F.sum(F.col(column).cast("decimal(38,0)")).alias(column)
    moved = [list(c) for c in centroids]
    for row in flat.groupBy("c", "at").agg(total("n"), total("x")).collect():  # clusters * components rows
        moved[row.c][row.at] = int(row.x) // int(row.n)
    tree.unpersist()
    return moved


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: Rounds = Rounds()
) -> DataFrame:
    """Assign every vector to the nearest of ``rounds.clusters`` centroids.

    Vectors become integers once and are stored; all later arithmetic is exact, so partitions
    and reruns cannot change a result. The first centroids are the vectors with the least
    sha256 of ``seed:id``. Each round broadcasts a vantage-point tree over the centroids
    (clusters * components integers, fixed by the parameters), assigns, adds up per task and
    then per cluster and component, and takes floors of means. No vector is shuffled.

    Returns ``id_col``, ``cluster``, ``distance`` (squared), ``centroid`` (array of long),
    ``cluster_inertia`` and ``inertia``. Vectors of another length, null, or with null or
    non-finite components take no part. A null id counts as the last in the first choice;
    repeated rows are clustered like others, and equal ids are told apart there by their
    vectors. With fewer vectors than clusters every vector is a first centroid. An empty table
    gives no rows; other columns are not looked at. Components beyond ``rounds.largest``
    (in scaled integers) raise an error, for their distances do not fit a long.
    """
    spark = vectors.sparkSession
    stored = through_table(whole_vectors(vectors, id_col, vector_col, rounds), "whole-vectors")
    named = F.sha2(F.concat(F.lit(f"{rounds.seed}:"), F.col("id").cast("string")), 256)
    first = stored.select(named.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(rounds.clusters)
    centroids = [list(row.v) for row in first.collect()]
    kind = stored.schema["id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame(
            [], f"`{id_col}` {kind}, cluster int, distance long, centroid array<long>, cluster_inertia long, inertia long"
        )
    for _ in range(rounds.rounds):
        centroids = _moved(stored, centroids, rounds)
    tree = spark.sparkContext.broadcast(vantage_tree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, label, apart in _searched(_matrix(batch.column(1), rounds), tree.value):
                ids = batch.column(0).slice(part.start, len(label))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(label.astype(np.int32)), pa.array(apart)], ["id", "cluster", "distance"]
                )

    assigned = through_table(stored.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = spark.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<long>")
    told = told.join(inertia, "cluster").crossJoin(inertia.agg(F.sum("cluster_inertia").alias("inertia")))
    return assigned.join(F.broadcast(told), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "centroid", "cluster_inertia", "inertia"
    )
