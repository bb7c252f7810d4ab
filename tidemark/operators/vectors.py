"""Exact cosine search over stored vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx

# The task functions travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries up to this number are sent to every task that reads points; for more the points are
#: stored in parts first, of which a query opens those its bounds do not rule out.
QUERIES_TOGETHER = 1024


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _usable(vector: str):
    """Vectors without missing or non-finite components."""
    component = F.transform(F.col(vector).cast("array<double>"), lambda x: x)
    good = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & good


class _Best:
    """k best rows of each query: higher scores first, then smaller keys."""

    def __init__(self, queries: pa.Table, k: int):
        self.k, self.groups = k, {}
        found = list(zip(queries.column(0).to_pylist(), queries.column(1).to_pylist()))
        for size in {len(v) for _, v in found}:
            same = [(i, v) for i, v in found if len(v) == size]
            units = _unit(np.array([v for _, v in same], dtype=np.float64))
            self.groups[size] = ([i for i, _ in same], units, [[] for _ in same])

    def offer(self, rows: pa.RecordBatch | pa.Table, vectors: pa.Array) -> None:
        """Score the rows, whose first column is the key, against queries of their length."""
        sizes = np.diff(vectors.offsets.to_numpy())
        for size, (_, units, kept) in self.groups.items():
            place = np.flatnonzero(sizes == size)
            if not len(place):
                continue
            same = vectors.take(pa.array(place))
            points = same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(place), size)
            scores = _unit(points) @ units.T
            for q, column in enumerate(scores.T):
                # Equal scores stay in, so ties are settled by key below.
                least = np.partition(column, -self.k)[-self.k] if len(column) > self.k else -np.inf
                if len(kept[q]) == self.k:
                    least = max(least, -kept[q][-1][0])
                enter = np.flatnonzero(column >= least)
                if len(enter):
                    chosen = rows.take(pa.array(place[enter]))
                    new = [(-float(s), *r) for s, r in zip(column[enter], zip(*(c.to_pylist() for c in chosen.columns)))]
                    kept[q] = sorted(kept[q] + new, key=lambda r: r[:2])[: self.k]

    def table(self, query_type: pa.DataType, types: list[pa.DataType], names: list[str]) -> pa.Table:
        flat = [(i, *r[1:], -r[0]) for ids, _, kept in self.groups.values() for i, rows in zip(ids, kept) for r in rows]
        columns = list(zip(*flat)) if flat else [[] for _ in range(len(types) + 2)]
        kinds = [query_type, *types, pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", *names, "score"])


def nearest(
    points: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    time: str | None = None,
    start=None,
    end=None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """Exact k nearest points by cosine for ``queries`` (``query_id`` and a vector named as the points').

    Points outside ``[start, end]`` of ``time`` are left out before scoring; so are vectors with
    missing or non-finite components, and a query only meets points of its length. Ties go by
    key. Up to ``QUERIES_TOGETHER`` queries go to the points, which are read once; a task keeps k
    candidates per query, and k per query and map task are ranked after the shuffle. More
    queries search a store of the points (``vector_store``), written once by this call. Result:
    ``query_id, key, payload…, score, place``.
    """
    if time is not None and start is not None:
        points = points.where(F.col(time) >= F.lit(start))
    if time is not None and end is not None:
        points = points.where(F.col(time) <= F.lit(end))
    names = [key, *payload]
    asked = queries.where(_usable(vector)).select("query_id", F.col(vector).cast("array<double>").alias("asked"))
    points = points.where(_usable(vector)).select(*names, F.col(vector).cast("array<double>").alias("vector"))
    query_type = asked.schema["query_id"].dataType.simpleString()
    columns = [f"{c} {points.schema[c].dataType.simpleString()}" for c in names]
    schema = ", ".join([f"query_id {query_type}", *columns, "score double"])
    few = asked.limit(QUERIES_TOGETHER + 1).toArrow()

    if few.num_rows <= QUERIES_TOGETHER:
        held = points.sparkSession.sparkContext.broadcast(few)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, types = _Best(held.value, k), None
            for batch in batches:
                types = [batch.column(i).type for i in range(len(names))]
                best.offer(batch.select(range(len(names))), batch.column(len(names)))
            if types is not None:
                yield from best.table(held.value.column(0).type, types, names).to_batches()

        candidates = points.mapInArrow(scan, schema)
    else:
        from tidemark.operators import vector_store

        store = vector_store.build_store(points, key, "vector", payload=payload)
        hits, _ = vector_store.search_store(store, asked.withColumnRenamed("asked", "vector"), k)
        return hits.select("query_id", *names, "score", "place")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return candidates.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)


def best_per_url(hits: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    return hits.groupBy(*by, "url").agg(F.max("score").alias("score"))


def retrieve_articles(
    points: DataFrame,
    news: DataFrame,
    queries: DataFrame,
    k: int = 5,
    urls: int = 10,
    length: int = 750,
    **window,
) -> DataFrame:
    """Nearest chunks -> best score per article -> the first ``urls`` articles with short text."""
    hits = nearest(points, queries, k, payload=["url"], **window)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "url")
    kept = (
        best_per_url(hits)
        .withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= urls)
    )
    articles = news.select("url", "title", "source", "pub_date", "text")
    return articles.join(kept, "url").withColumn("text", tx.shorten(F.col("text"), length))


def retrieve(
    mode: str,
    news: DataFrame,
    start: str,
    end: str,
    limit: int = 5,
    points: DataFrame | None = None,
    query: DataFrame | None = None,
    query_text: str | None = None,
    channel: str | None = None,
) -> DataFrame:
    """``mode="vector"`` ranks by cosine, ``mode="text"`` by token matches."""
    from tidemark.operators.search import search_news

    if mode == "vector":
        found = retrieve_articles(
            points, news, query, k=limit, time="pub_date",
            start=start, end=end,
        )
        return found.select("url", "title", "source", "pub_date", F.col("score"), "text")
    if mode != "text":
        raise ValueError("mode is 'vector' or 'text'")
    found = search_news(news, query_text, start, end, limit=limit, channel=channel)
    if "text" not in found.columns:
        found = found.withColumn("text", F.lit(None).cast("string"))
    return found.select(
        "url", "title", "source", "pub_date", F.col("score").cast("double").alias("score"), "text"
    )
