"""Jobs that build the ratio table from statement facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import days_scaled
from tidemark.operators import ratios as r
from tidemark.operators import statements as st
from tidemark.sources.workspace import through_table

COLUMNS = ["stock_code", "year", "quarter", "ratio_code", "data", "date_added", "segment"]


def segment_ratios(
    facts: DataFrame,
    segment: str,
    prices: DataFrame | None = None,
    notes: DataFrame | None = None,
    families: Sequence[str] = r.DEFAULT_FAMILIES,
    codes: Sequence[str] | None = None,
    fill_undefined: bool = True,
) -> DataFrame:
    """Finished ratio rows of one segment.

    ``prices`` are quarter-end prices ``(stock_code, year, quarter, close)``;
    ``notes`` are further facts. Undefined ratios become 0 unless
    ``fill_undefined`` is off.
    """
    columns = ["stock_code", "year", "quarter", "category_code", "data", "date_added"]
    rows = facts.select(columns)
    if notes is not None:
        rows = st.stacked(rows, notes.select([c for c in columns if c in notes.columns]))
    if prices is not None:
        price_rows = prices.select(
            "stock_code",
            "year",
            "quarter",
            F.lit("Price").alias("category_code"),
            F.col("close").cast("double").alias("data"),
        )
        rows = st.stacked(rows, price_rows)
    # A period's date comes out of the same aggregation as its accounts. Periods
    # (and entities) known from prices alone have none and drop out here.
    long = r.financial_ratios(rows, segment, families, codes, period_columns=["date_added"])
    long = r.with_ratio_codes(long.where(F.col("date_added").isNotNull()))
    long = st.without_annual_ttm(long)
    long = long.withColumn(
        "data", days_scaled(F.col("ratio_code"), F.col("quarter"), F.col("data"))
    ).withColumn("segment", F.lit(segment))
    if fill_undefined:
        long = long.fillna(0.0, subset=["data"])
    return long.select(*COLUMNS, "family")


def _each_segment(
    facts_by_segment: Mapping[str, DataFrame],
    prices: DataFrame | None,
    notes: DataFrame | None,
    codes: Mapping[str, Sequence[str]] | None,
    **options,
) -> DataFrame:
    """Finished ratio rows of all segments; notes are the banks'."""
    parts = [
        segment_ratios(
            f, s, prices, notes if s == "bank" else None, codes=codes and codes[s], **options
        ).select(COLUMNS)
        for s, f in facts_by_segment.items()
    ]
    return st.stacked(*parts)


def _charts(
    facts_by_segment: Mapping[str, DataFrame], prices: DataFrame | None, notes: DataFrame | None
) -> dict[str, list[str]]:
    """The accounts that occur in each segment's facts."""
    found = {}
    for s, f in facts_by_segment.items():
        wanted = set(r.rb.account_codes(r.rb.BINDINGS[s]))
        rows = f if notes is None or s != "bank" else st.stacked(*(x.select("category_code") for x in (f, notes)))
        found[s] = [*r.codes_present(rows, wanted), *(["Price"] if prices is not None else [])]
    return found


def industry_means(
    facts_by_segment: Mapping[str, DataFrame],
    companies: DataFrame,
    prices: DataFrame | None = None,
    universal: DataFrame | None = None,
    notes: DataFrame | None = None,
    top: int = 15,
    codes: Mapping[str, Sequence[str]] | None = None,
    **options,
) -> DataFrame:
    """Mean ratios of each industry's ``top`` entities, as ``industry_ratios`` has them.

    Ratios of an entity depend on its own facts only, so they are made for entities that are
    among the largest of some period: ``top`` an industry and period at most, however many
    companies report. The charts of accounts are those of all facts.
    """
    if codes is None:
        codes = _charts(facts_by_segment, prices, notes)
    ranked_by = universal if universal is not None else st.stacked(*facts_by_segment.values())
    members = through_table(st.largest_entities(ranked_by, companies, top=top).drop("rank"), "members")
    entities = members.select("stock_code").distinct()

    def own(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.join(entities, "stock_code", "left_semi")

    facts = {s: own(f) for s, f in facts_by_segment.items()}
    return st.member_means(_each_segment(facts, own(prices), own(notes), codes, **options), members)


def industry_rows(*args, **options) -> DataFrame:
    """``industry_means`` as rows of the ratio table, segment ``industry``."""
    return industry_means(*args, **options).select(
        F.col("industry").alias("stock_code"),
        "year",
        "quarter",
        "ratio_code",
        F.col("data_mean").alias("data"),
        "date_added",
        F.lit("industry").alias("segment"),
    )


def ratio_table(
    facts_by_segment: Mapping[str, DataFrame],
    companies: DataFrame,
    prices: DataFrame | None = None,
    universal: DataFrame | None = None,
    notes: DataFrame | None = None,
    top: int = 15,
    codes: Mapping[str, Sequence[str]] | None = None,
    **options,
) -> DataFrame:
    """Ratios of every segment plus industry means as rows of segment ``industry``.

    ``universal`` are the facts the industries' largest entities are ranked
    by; the segments' own facts serve when it is omitted. ``codes`` are the
    segments' charts of accounts; without them each is looked up in the facts.
    The facts are read for the rows and again for the means, so stored ones are best.
    """
    if codes is None:
        codes = _charts(facts_by_segment, prices, notes)
    rows = _each_segment(facts_by_segment, prices, notes, codes, **options)
    means = industry_rows(facts_by_segment, companies, prices, universal, notes, top, codes, **options)
    return st.stacked(rows, means)
