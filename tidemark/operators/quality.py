"""Data-quality checks run before a load; each returns the offending rows or counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values per group, computed as a de-duplication before the count."""
    return df.groupBy(*by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def reconciliation(fact: DataFrame, mapping: DataFrame, column: str = "category_code") -> DataFrame:
    """Codes found on one side only, with the side that lacks them; each side is read once."""
    sides = fact.select(column, F.lit(True).alias("__fact")).unionByName(
        mapping.select(column, F.lit(False).alias("__fact"))
    )
    found = sides.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.bool_or("__fact").alias("__in_fact"), F.bool_and("__fact").alias("__only_fact")
    )
    missing = F.when(F.col("__only_fact"), "mapping").when(~F.col("__in_fact"), "fact")
    return found.select(column, missing.alias("missing_in")).where(F.col("missing_in").isNotNull())


def checked_write(
    df: DataFrame,
    path: str,
    checks: Mapping[str, Column],
    measures: Mapping[str, Column] | None = None,
    most_failures: int | None = 0,
) -> tuple[dict[str, object], DataFrame]:
    """Write ``df`` and check it in the same scan.

    ``checks`` are conditions every row should meet; a row that does not (null counts as not
    met) goes to ``path/passed=false`` with the names of its failed checks, all others to
    ``path/passed=true``. Observed beside the write: ``rows``, the number of failures per check
    and ``measures`` (aggregates without DISTINCT). More than ``most_failures`` failing rows stop
    the job with an error after the write, so the rows can be looked at; None lets all through.

    Returns the observed values and the failing rows (with ``failed``, an array of names).
    """
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    told = df.withColumn("failed", failed)
    counts = [F.count_if(F.array_contains("failed", n)).alias(n) for n in checks]
    extra = [m.alias(n) for n, m in (measures or {}).items()]
    seen = Observation()
    observed = told.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("failed") > 0).alias("failing_rows"), *counts, *extra
    )
    observed.withColumn("passed", F.size("failed") == 0).write.mode("overwrite").partitionBy("passed").parquet(path)
    values = seen.get
    if most_failures is not None and values["failing_rows"] > most_failures:
        raise ValueError(f"{values['failing_rows']} of {values['rows']} rows fail: {values}")
    schema = told.withColumn("passed", F.lit(True)).schema
    stored = df.sparkSession.read.schema(schema).parquet(path)
    return values, stored.where(~F.col("passed")).drop("passed")
