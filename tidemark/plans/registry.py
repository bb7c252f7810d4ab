"""Registered queries, each with its comparison SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.oracle_views import with_views
from tidemark.plans.derived_views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", extra: dict[str, str] | None = None):
    """Register a function ``Tables -> DataFrame`` under an inventory id."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql, extra)
        return build

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from tidemark.plans import (  # noqa: F401
        catalog_datasets,
        catalog_io,
        catalog_ratios,
        catalog_series,
        catalog_statements,
        catalog_text,
    )
