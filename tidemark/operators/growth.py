"""Comparisons between fiscal periods of one entity.

All operators here work on rows that are unique per entity and period, so an
entity's window holds five rows per year at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import measures, periods

ENTITY = "stock_code"


def _annual() -> Column:
    return F.col("quarter") == 0


def _index() -> Column:
    return periods.quarter_index(F.col("year"), F.col("quarter"))


def run_window(*extra: str):
    """Rows of one entity in period order, annual and quarterly rows apart."""
    return Window.partitionBy(ENTITY, *extra, _annual()).orderBy("year", "quarter")


def contiguous(window, rows: int = 4) -> Column:
    """True when the row and the ``rows - 1`` before it are consecutive quarters."""
    return _index() - F.lag(_index(), rows - 1).over(window) == rows - 1


def trailing_sum(x: Column, window, calendar: bool = True) -> Column:
    """Sum of four rows; null unless all four have a value (and are consecutive quarters)."""
    frame = window.rowsBetween(-3, 0)
    whole = F.count(x).over(frame) == 4
    return F.when(whole & contiguous(window) if calendar else whole, F.sum(x).over(frame))


def trailing_average(x: Column, window, calendar: bool = True) -> Column:
    """Mean of the first and last of four rows, under the conditions of ``trailing_sum``."""
    frame = window.rowsBetween(-3, 0)
    whole = F.count(x).over(frame) == 4
    return F.when(
        whole & contiguous(window) if calendar else whole, (F.lag(x, 3).over(window) + x) / 2
    )


def previous_row_average(x: Column, window) -> Column:
    """Mean with the previous row that has a value; the first one is averaged with 0."""
    earlier = F.last(x, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.when(x.isNotNull(), (x + F.coalesce(earlier, F.lit(0.0))) / 2)


def _prior_year():
    return Window.partitionBy(ENTITY).orderBy("year").rangeBetween(-1, -1)


def prior_annual(x: Column) -> Column:
    """The annual figure of the year before."""
    return F.max(F.when(_annual(), x)).over(_prior_year())


def has_prior_annual() -> Column:
    return F.max(F.when(_annual(), F.lit(1))).over(_prior_year()).isNotNull()


def annual_average(x: Column) -> Column:
    """Mean of the current value and the prior year's annual figure."""
    return (x + prior_annual(x)) / 2


def same_period_last_year(x: Column) -> Column:
    window = Window.partitionBy(ENTITY, "quarter").orderBy("year")
    return F.when(F.lag("year").over(window) == F.col("year") - 1, F.lag(x).over(window))


def previous_quarter(x: Column) -> Column:
    """Value of the quarter before; a first quarter looks at last year's fourth."""
    window = run_window()
    near = contiguous(window, 2) & ~_annual()
    return F.when(near, F.lag(x).over(window))


def yearly_growth(x: Column) -> Column:
    return measures.growth(x, same_period_last_year(x))


def quarterly_growth(x: Column) -> Column:
    return measures.growth(x, previous_quarter(x))


def trailing_twelve_months(
    facts: DataFrame, codes: Sequence[str] | None = None, calendar: bool = True
) -> DataFrame:
    """Trailing sums of quarterly facts as new rows whose code ends in ``_TTM``.

    ``calendar=False`` counts rows instead of consecutive quarters.
    """
    rows = facts.where(F.col("quarter") != 0)
    if codes is not None:
        rows = rows.where(F.col("category_code").isin(list(codes)))
    window = Window.partitionBy(ENTITY, "category_code").orderBy("year", "quarter")
    return (
        rows.withColumn("__ttm", trailing_sum(F.col("data"), window, calendar))
        .where(F.col("__ttm").isNotNull())
        .withColumn("data", F.col("__ttm"))
        .withColumn("category_code", F.concat("category_code", F.lit("_TTM")))
        .drop("__ttm")
    )
