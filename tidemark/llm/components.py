"""Connected components of a stored list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.sources.workspace import through_table


def _nearest(links: DataFrame, label: str) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return through_table(least, label)


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another node."""
    inner = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return inner.isEmpty() and edges.count() == edges.select("u").distinct().count()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for linked nodes.

    ``links`` has comparable columns ``a`` and ``b``. Rounds of large stars and small stars
    turn every component into a star around its smallest node. A round is two aggregations,
    combined before the shuffle, and two joins of stored tables, which Spark may split; nothing
    is gathered per node. Each round is a table, so lost executors cost a round at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = through_table(edges, "links")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        # Large star: neighbours above a node hang on the smallest of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both, "large-star").select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = through_table(large.where("u <> v").distinct(), "large-links")
        # Small star: neighbours below a node, and the node, hang on the smallest of them.
        least = _nearest(large, "small-star")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = through_table(small.where("u <> v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
