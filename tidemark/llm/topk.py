"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.workspace import through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block of points, and of a group of queries, about and at most.
BLOCK, GROUP = 2048, 1024
#: Vectors of a sample whose nearest one tells the cell of a row; cells are the top of the tree.
PIVOTS = 64
_LEAF = 16
#: Groups that meet a block in one task.
_GROUPS_TOGETHER = 16
#: Blocks whose bounds are looked at in one task.
_BLOCKS_TOGETHER = 1024
_HITS = "query_id long, vec_id long, score long"


class Node:
    """``points`` within ``radius`` of ``center``; a node without children is a leaf."""

    __slots__ = ("points", "center", "norm", "radius", "children")

    def __init__(self, vectors: np.ndarray, points: np.ndarray):
        self.points, self.center = points, vectors[points[0]]
        far = np.sqrt(((vectors[points] - self.center) ** 2).sum(1))
        self.norm, self.radius, self.children = float(np.sqrt((self.center**2).sum())), float(far.max()), []
        if len(points) <= _LEAF or self.radius == 0:
            return
        # A net: no two of its centers are closer than half the radius, and it covers all.
        cells, left = [], points
        while len(left):
            near = ((vectors[left] - vectors[left[0]]) ** 2).sum(1) <= (self.radius / 2) ** 2
            cells.append(left[near])
            left = left[~near]
            if len(cells) * 2 > len(points):  # too far apart to gain anything from more nodes
                return
        self.children = [Node(vectors, c) for c in cells]


class Best:
    """The k best hits of each query so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.hits: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), -np.inf) if worst is None else worst.astype(float)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for row, found in zip(rows, scores):
            good = np.flatnonzero((found >= self.worst[row]) & (ids != self.ids[row]))
            if len(good) > self.k:
                least = np.partition(found[good], len(good) - self.k)[len(good) - self.k]
                good = good[found[good] >= least]
            if not len(good):
                continue
            joined = self.hits[row] + [(-s, i) for s, i in zip(found[good].tolist(), ids[good].tolist())]
            self.hits[row] = sorted(joined)[: self.k]
            if len(self.hits[row]) == self.k:
                self.worst[row] = max(self.worst[row], -self.hits[row][-1][0])

    def table(self) -> pa.Table:
        rows = [(int(q), i, int(-s)) for q, hits in zip(self.ids, self.hits) for s, i in hits]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


def bound(a_center, a_norm, a_radius, b_center, b_norm, b_radius) -> float:
    """No inner product of a point of one ball with a point of the other is larger."""
    top = float(a_center @ b_center) + a_norm * b_radius + b_norm * a_radius + a_radius * b_radius
    return top + 1e-9 * (abs(top) + a_norm * b_norm + 1)  # for rounding


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Walk both trees together, leaving out pairs of nodes that cannot change any query's hits."""
    if not len(queries) or not len(points):
        return
    stack = [(Node(queries, np.arange(len(queries))), Node(points, np.arange(len(points))))]
    while stack:
        q, p = stack.pop()
        if bound(q.center, q.norm, q.radius, p.center, p.norm, p.radius) < best.worst[q.points].min():
            continue
        if not q.children and not p.children:
            best.offer(q.points, queries[q.points] @ points[p.points].T, ids[p.points])
        elif p.children and (not q.children or p.radius > 2 * q.radius):
            # The most promising child is on top of the stack.
            stack += [(q, c) for c in sorted(p.children, key=lambda c: float(q.center @ c.center))]
        else:
            stack += [(c, p) for c in q.children]


def _matrix(table: pa.Table, name: str = "vector") -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _ids(table: pa.Table, name: str = "vec_id") -> np.ndarray:
    return table.column(name).to_numpy()


def top_k(
    points: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row where ``is_query`` holds.

    Components become floor(scale * x); scores are exact while they stay below 2^53. Rows go
    to the cell of the nearest of at most ``PIVOTS`` sampled rows and cells to blocks of about
    ``BLOCK`` rows, so that many equal vectors are many blocks. Queries form groups by block.
    Each group searches its own block first; then a pair of a group and another block is left
    out if the bound by their covering radii is below the group's worst kth score. The pairs
    that remain are searched by walking the cover trees of both sides. Every row is in a block.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller id;
    fewer than ``k`` rows if there are no more. Rows with a null id, or whose vector is null,
    empty or holds null or non-finite components, take no part; vectors only meet vectors of
    their length. Rows that share the query's id count as the query's own; other repeated rows
    are candidates each. An empty table gives no rows; other columns are not looked at.
    """
    spark = points.sparkSession
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(scale) * x)
    base = points.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    pivots = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("vector").toArrow()
    by_size: dict[int, list] = {}
    for v in pivots.column("vector").to_pylist():
        by_size.setdefault(len(v), []).append(np.floor(np.array(v)))
    centers = {n: np.array(c) for n, c in by_size.items()}

    def locate(batches):
        for batch in batches:
            vectors, cells = [], []
            for v in batch.column(2).to_pylist():
                v = np.floor(np.array(v))
                near = centers.get(len(v))
                vectors.append(v)
                cells.append(len(v) * PIVOTS + (int(((near - v) ** 2).sum(1).argmin()) if near is not None else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64())), pa.array(cells, pa.int64())],
                ["vec_id", "asks", "vector", "cell"],
            )

    located = through_table(base.mapInArrow(locate, "vec_id long, asks boolean, vector array<double>, cell long"), "topk-cells")
    # Cells are pivots times vector lengths; each is cut into parts by a hash of the id.
    parts = through_table(
        located.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.ceil(F.count(F.when(F.col("asks"), 1)) / GROUP).cast("int").alias("groups")), "topk-parts"
    )
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))
    group = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.greatest("groups", F.lit(1)))
    dealt = located.join(parts, "cell").select(
        "vec_id", "asks", "vector", F.concat_ws(":", "cell", part).alias("block"), F.concat_ws(":", "cell", part, group).alias("group")
    )
    dealt = through_table(dealt, "topk-blocks")
    refs = dealt.select("block", "vec_id", "vector")
    queries = dealt.where("asks").select("group", "block", F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(_ids(left, "query_id"), k)
        search(_matrix(left, "asked"), best.ids, _matrix(right), _ids(right), best)
        return best.table()

    first = queries.groupBy("block").cogroup(refs.groupBy("block")).applyInArrow(own, _HITS)
    first = through_table(first, "topk-own")
    full = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    full = full.where(F.col("n") >= k).select("query_id", F.col("worst").cast("double").alias("worst"))
    asked = queries.join(through_table(full, "topk-worst"), "query_id", "left").select(
        "group", "block", "query_id", "asked", F.coalesce("worst", F.lit(float("-inf"))).alias("worst")
    )
    asked = through_table(asked, "topk-asked")

    def ball(name: str, vectors: str, worst: bool):
        def run(table: pa.Table) -> pa.Table:
            x = _matrix(table, vectors)
            center = np.floor(x.mean(0))
            radius = float(np.sqrt(((x - center) ** 2).sum(1).max()))
            got = {name: [table.column(name)[0].as_py()], "center": [center], "radius": [radius]}
            if worst:
                got |= {"block": [table.column("block")[0].as_py()], "worst": [float(_ids(table, "worst").min())]}
            return pa.table(got)

        return run

    blocks = refs.groupBy("block").applyInArrow(ball("block", "vector", False), "block string, center array<double>, radius double")
    blocks = through_table(blocks, "topk-balls")
    groups = asked.groupBy("group").applyInArrow(
        ball("group", "asked", True), "group string, center array<double>, radius double, block string, worst double"
    )
    chunks = max(1, math.ceil(blocks.count() / _BLOCKS_TOGETHER))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    every = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[str, str]] = []
        there = [(r["block"], np.array(r["center"]), r["radius"]) for r in right.to_pylist()]
        for g in left.to_pylist():
            c = np.array(g["center"])
            for block, center, radius in there:
                if block != g["block"] and len(center) == len(c):
                    top = bound(c, float(np.sqrt(c @ c)), g["radius"], center, float(np.sqrt(center @ center)), radius)
                    if top >= g["worst"]:
                        found.append((g["group"], block))
        columns = list(zip(*found)) if found else [[], []]
        return pa.table({n: pa.array(x, pa.string()) for n, x in zip(("group", "block"), columns)})

    pairs = every.groupBy("chunk").cogroup(blocks.withColumn("chunk", chunk).groupBy("chunk")).applyInArrow(pair, "group string, block string")
    together = F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(blocks.count() / _GROUPS_TOGETHER)))).cast("int")
    pairs = through_table(pairs.withColumn("batch", together), "topk-pairs")
    meets = F.concat_ws("/", "block", "batch")
    sent = pairs.join(asked.drop("block"), "group").select(meets.alias("meets"), "query_id", "asked", "worst")
    met = pairs.select("block", meets.alias("meets")).distinct().join(refs, "block").drop("block")

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(_ids(left, "query_id"), k, _ids(left, "worst"))
        search(_matrix(left, "asked"), best.ids, _matrix(right), _ids(right), best)
        return best.table()

    more = sent.groupBy("meets").cogroup(met.groupBy("meets")).applyInArrow(others, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
