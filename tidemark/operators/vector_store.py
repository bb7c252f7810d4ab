"""Exact cosine search over stored parts of vectors, skipping parts by their bounds."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import vectors
from tidemark.sources.workspace import through_buckets, through_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors sampled as pivots of cells, at most; every row is stored, whatever the sample.
MOST_PIVOTS = 1024
#: Bounds are worked out for blocks of so many queries and so many parts.
BLOCK = 2048
#: Queries searched together; a part meets at most so many.
LOT = 65_536
#: Parts a query opens at first, before the bounds of the others meet its k-th score.
FIRST_PARTS = 2
#: Far above the rounding of scores and bounds.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorStore:
    """``points`` (in buckets of ``part``) and ``parts`` (a row each: centre, radius, time range)."""

    points: DataFrame
    parts: DataFrame
    key: str
    payload: tuple[str, ...]


def build_store(
    points: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    time: str | None = None,
    payload: Sequence[str] = (),
    part_rows: int = 2048,
) -> VectorStore:
    """Store vectors in parts of nearby directions and close times.

    A vector joins the cell of the most similar of at most ``MOST_PIVOTS`` sampled vectors of its
    length. Rows are range-sorted by cell and time and cut into parts of at most ``part_rows``;
    each part keeps its mean direction, the greatest distance from it and its first and last
    time. The number of parts grows with the rows; a large cell is cut by time. Vectors with
    missing or non-finite components are left out.
    """
    at = F.col(time) if time else F.lit(None).cast("timestamp")
    names = [key, *payload]
    usable = points.where(vectors._usable(vector)).select(
        *names, at.alias("__at"), F.col(vector).cast("array<double>").alias("vector")
    )
    rows = usable.count()
    pivots = max(1, min(MOST_PIVOTS, rows // part_rows))
    chosen = usable.orderBy(F.xxhash64(key), key).limit(pivots).select("vector").collect()
    cells: dict[int, np.ndarray] = {}
    for size in {len(r.vector) for r in chosen}:
        cells[size] = vectors._unit(np.array([r.vector for r in chosen if len(r.vector) == size]))
    held = usable.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(column.offsets.to_numpy())
            cell = sizes.astype(np.int64) << 20
            for size, units in held.value.items():
                same = np.flatnonzero(sizes == size)
                data = column.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).reshape(len(same), size)
                cell[same] += (vectors._unit(data) @ units.T).argmax(axis=1) if len(same) else 0
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in filter(len, batches):
            cell = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            ends = [e for a, b in zip(edges[:-1], edges[1:]) for e in (*range(a + part_rows, b, part_rows), b)]
            sizes = np.diff(ends, prepend=0)
            part = number + np.repeat(np.arange(len(ends)), sizes)
            number += len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns[1:]], ["part", *batch.schema.names[1:]])

    fields = ", ".join(f"`{c}` {usable.schema[c].dataType.simpleString()}" for c in usable.columns)
    celled = usable.mapInArrow(place, f"cell long, {fields}")
    spread = celled.repartitionByRange("cell", "__at", key).sortWithinPartitions("cell", "__at", key)
    stored = through_buckets(spread.mapInArrow(cut, f"part long, {fields}"), "vectors", "part", math.ceil(rows / part_rows / 8))

    def describe(table: pa.Table) -> pa.Table:
        data = np.array(table.column("vector").to_pylist())
        units = vectors._unit(data)
        centre = units.mean(axis=0)
        radius = float(np.sqrt(((units - centre) ** 2).sum(axis=1)).max())
        span = pc.min_max(table.column("__at"))
        return pa.table(
            {
                "part": table.column("part").slice(0, 1),
                "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                "radius": [radius],
                "rows": [table.num_rows],
                "low": pa.array([span["min"]]),
                "high": pa.array([span["max"]]),
            }
        )

    kind = usable.schema["__at"].dataType.simpleString()
    described = stored.select("part", "__at", "vector").groupBy("part").applyInArrow(
        describe, f"part long, centre array<double>, radius double, rows long, low {kind}, high {kind}"
    )
    return VectorStore(stored, through_table(described, "vector-parts"), key, tuple(payload))


def _bounds(queries: pa.Table, parts: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, part rows, upper bounds of scores) for queries and parts of one length.

    With unit or zero vectors q and p, and p within r of c: q.p <= q.c + |q| r, and
    q.p = (|q|^2 + |p|^2 - |q - p|^2) / 2 where |p| <= 1 and |q - p| >= |q - c| - r.
    """
    asked, centres = queries.column("asked").to_pylist(), parts.column("centre").to_pylist()
    radius = parts.column("radius").to_numpy()
    for size in {len(v) for v in asked} & {len(c) for c in centres}:
        q = np.array([i for i, v in enumerate(asked) if len(v) == size])
        p = np.array([i for i, c in enumerate(centres) if len(c) == size])
        units, middle, r = vectors._unit(np.array([asked[i] for i in q])), np.array([centres[i] for i in p]), radius[p]
        dot, own = units @ middle.T, (units**2).sum(axis=1)[:, None]
        apart = np.sqrt(np.maximum(own + (middle**2).sum(axis=1) - 2 * dot, 0))
        far = (own + 1 - np.maximum(apart - r, 0) ** 2) / 2
        yield q, p, np.minimum(dot + np.sqrt(own) * r, far) + SLACK


def _meeting(queries: DataFrame, parts: DataFrame, opened, schema: str) -> DataFrame:
    """``opened`` of every block of queries and every block of parts."""
    query_blocks = max(1, math.ceil(queries.count() / BLOCK))
    part_blocks = max(1, math.ceil(parts.count() / BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("b", each(part_blocks))
    right = parts.withColumn("d", F.pmod(F.xxhash64("part"), F.lit(part_blocks)).cast("int")).withColumn("c", each(query_blocks))
    return left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(opened, schema)


def search_store(
    store: VectorStore, queries: DataFrame, k: int = 5, start=None, end=None
) -> tuple[DataFrame, DataFrame]:
    """Exact k nearest points by cosine for any number of ``queries`` (``query_id``, ``vector``).

    A query first opens the parts with the best bounds, and more of them while it has fewer than
    k hits; then those others whose bound reaches its k-th score (equal ones too), so a part
    whose bound lies below is never scored.
    Parts outside ``[start, end]`` are not looked at. Stored points are read where they lie and
    copied for no query; only query vectors travel to the parts they open. More than ``LOT``
    queries are searched in several lots. Ties go by key; a query meets points of its length.

    Returns hits (``query_id``, key, payload…, ``score``, ``place``) and a report per query:
    ``parts`` within the dates and ``opened``.
    """
    parts = store.parts
    points = store.points
    if start is not None:
        parts, points = parts.where(F.col("high") >= F.lit(start)), points.where(F.col("__at") >= F.lit(start))
    if end is not None:
        parts, points = parts.where(F.col("low") <= F.lit(end)), points.where(F.col("__at") <= F.lit(end))
    parts = parts.select("part", "centre", "radius")
    names = [store.key, *store.payload]
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = through_table(
        queries.where(vectors._usable("vector")).select("query_id", F.col("vector").cast("array<double>").alias("asked")),
        "vector-queries",
    )
    lots = max(1, math.ceil(asked.count() / LOT))
    total = parts.count()
    fields = [f"`{c}` {points.schema[c].dataType.simpleString()}" for c in names]
    found_schema = ", ".join([f"query_id {kind}", *fields, "score double"])
    pair_schema = f"query_id {kind}, part long, bound double, asked array<double>"

    def pairs(left: pa.Table, right: pa.Table, chosen: Iterator[tuple[int, int, float]]) -> pa.Table:
        q, p, bound = (list(c) for c in zip(*chosen)) if (chosen := list(chosen)) else ([], [], [])
        return pa.table(
            {
                "query_id": left.column("query_id").take(pa.array(q, pa.int64())),
                "part": right.column("part").take(pa.array(p, pa.int64())),
                "bound": pa.array(bound, pa.float64()),
                "asked": left.column("asked").take(pa.array(q, pa.int64())),
            }
        )

    def opener(most: int | None):
        """Pairs of a query with the ``most`` best parts it has not opened, or with all that reach
        its k-th score."""

        def chosen(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, float]]:
            least = left.column("least").to_numpy()
            done, place = [set(x) for x in left.column("done").to_pylist()], right.column("part").to_pylist()
            for q, p, bound in _bounds(left, right):
                for i, row in zip(q, bound):
                    fresh = (j for j in np.argsort(-row, kind="stable") if place[p[j]] not in done[i])
                    if most is not None:
                        yield from ((int(i), int(p[j]), float(row[j])) for j in islice(fresh, most))
                    else:
                        reach = takewhile(lambda j: row[j] >= least[i], fresh)  # noqa: B023
                        yield from ((int(i), int(p[j]), float(row[j])) for j in reach)

        return lambda left, right: pairs(left, right, chosen(left, right))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = vectors._Best(right.select(["query_id", "asked"]), k)
        rows = left.select(names).combine_chunks()
        if left.num_rows:
            kept.offer(rows, left.column("vector").combine_chunks())
        return kept.table(right.schema.field("query_id").type, [f.type for f in rows.schema], names)

    def scored(opened: DataFrame, label: str) -> DataFrame:
        wanted = opened.select(F.col("part").alias("of"), "query_id", "asked")
        read = points.join(opened.select("part").distinct(), "part", "left_semi")
        met = read.groupBy("part").cogroup(wanted.groupBy("of")).applyInArrow(score, found_schema)
        return through_table(met, label)

    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), store.key)
    hits, visits = [], []
    for lot in range(lots):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(lots)) == lot)
        opened = mine.select("query_id", F.lit(None).cast("long").alias("part")).limit(0)
        found, most = mine.select("query_id").limit(0), FIRST_PARTS
        known = mine.withColumns({"done": F.array().cast("array<long>"), "least": F.lit(float("-inf"))})
        while True:  # until every query has k hits or has opened all parts; four times as many each time
            by_bound = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "part")
            wanting = known.where((F.col("least") == float("-inf")) & (F.size("done") < total))
            more = _meeting(wanting, parts, opener(most), pair_schema)
            more = more.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= most).drop("n")
            more = through_table(more, "vector-opened")
            if more.isEmpty():
                break
            opened = opened.unionByName(more.select("query_id", "part"))
            found = found.unionByName(scored(more, "vector-hits"), allowMissingColumns=True)
            top = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k)
            kth = top.where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
            done = opened.groupBy("query_id").agg(F.collect_list("part").alias("done"))
            known = mine.join(done, "query_id").join(kth, "query_id", "left").fillna({"least": float("-inf")})
            most *= 4
        last = through_table(_meeting(known, parts, opener(None), pair_schema), "vector-opened")
        hits += [found, scored(last, "vector-hits")]
        visits += [opened.select("query_id"), last.select("query_id")]
    together = hits[0]
    for more in hits[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    found = together.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    seen = visits[0]
    for more in visits[1:]:
        seen = seen.unionByName(more)
    report = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("opened"))
    report = asked.select("query_id").join(report, "query_id", "left").select(
        "query_id", F.lit(total).cast("long").alias("parts"), F.coalesce("opened", F.lit(0)).cast("long").alias("opened")
    )
    return found, report
