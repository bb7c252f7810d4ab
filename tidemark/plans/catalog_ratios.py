"""Ratio families, the assembled ratio table and industry means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ratios as r
from tidemark.operators import statements as st
from tidemark.plans import ratio_sql, ratio_tables, statement_tables
from tidemark.plans.registry import query
from tidemark.plans.derived_views import SEGMENTS, base_codes
from tidemark.sources.workspace import through_table

_TRAILING = """
    SELECT stock_code, segment, category_code || '_TTM' AS category_code, year, quarter, ttm AS data FROM (
      SELECT *, sum(data) OVER w AS ttm, count(data) OVER w AS n,
        year * 4 + quarter - lag(year * 4 + quarter, 3) OVER (PARTITION BY stock_code, category_code ORDER BY year, quarter) AS width
      FROM statement WHERE quarter <> 0 AND (category_code LIKE 'IS%' OR category_code LIKE 'CF%')
        AND category_code NOT IN ('IS_004', 'IS_005', 'IS_006', 'IS_007', 'IS_023', 'IS_025', 'CF_002', 'CF_024', 'CF_025', 'CF_038')
      WINDOW w AS (PARTITION BY stock_code, category_code ORDER BY year, quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    WHERE n = 4 AND width = 3"""


def stored_facts(t):
    """Facts with trailing rows and prices, written once by segment, and the accounts of each.

    A segment reads its part only. The accounts that occur, a chart of accounts a segment, are
    looked up for all of them in one pass over the stored codes.
    """
    owners = t.companies.select("stock_code", "segment")
    prices = t.prices.join(owners, "stock_code").select(
        "stock_code", F.lit("Price").alias("category_code"), "year", "quarter",
        F.col("close").alias("data"), "segment",
    )
    rows = st.stacked(statement_tables.with_trailing_rows(t.statement), prices)
    table = through_table(rows, "facts", partition_by=["segment"])
    found = table.groupBy("segment").agg(F.collect_set("category_code").alias("codes")).collect()
    codes = {s: [] for s in SEGMENTS} | {row["segment"]: row["codes"] for row in found}
    return {s: table.where(F.col("segment") == s) for s in SEGMENTS}, codes


def needs_trailing(families) -> bool:
    wanted = [c for s in SEGMENTS for c in r.rb.account_codes(r.rb.BINDINGS[s], families)]
    return any(c.endswith("_TTM") for c in wanted)


def segment_facts(t, segment):
    """A segment's statements and its chart of accounts."""
    return t.segment_statement(segment), [*base_codes(segment), "Price"]


def with_prices(t, rows):
    """Facts with the quarter-end prices of the same entities."""
    own = rows.select("stock_code").distinct()
    price = t.prices.join(own, "stock_code", "left_semi")
    return st.stacked(
        rows,
        price.select(
            "stock_code", F.lit("Price").alias("category_code"), "year", "quarter", F.col("close").alias("data")
        ),
    )


def family(name: str, *families: str, price: bool = False):
    """Register a ratio family over all segments that have it."""
    sql = ratio_sql.families_sql(families)

    def build(t):
        parts = []
        stored, found = stored_facts(t) if needs_trailing(families) else ({}, {})
        for segment in SEGMENTS:
            bindings = r.rb.BINDINGS[segment]
            if not any(bindings.get(f) or f in ("yoy", "qoq") for f in families):
                continue
            rows, codes = (stored[segment], found[segment]) if stored else segment_facts(t, segment)
            rows = with_prices(t, rows) if price else rows
            parts.append(r.financial_ratios(rows, segment, families, codes))
        return st.stacked(*parts)

    build.__doc__ = f"Ratios of the families {', '.join(families)}, every segment."
    query(name, sql, "statement prices", ratio_sql.facts_views(_TRAILING, price))(build)


family("rat_struct", "structure")
family("rat_liq", "liquidity")
family("rat_risk", "risk")
family("rat_inc", "income")
family("rat_prof", "profitability")
family("rat_cash", "cashflow")
family("rat_avg", "average")
family("rat_avgttm", "average_ttm")
family("rat_pe", "price", price=True)
family("rat_days", "days")
family("rat_yoy", "yoy")
family("rat_qoq", "qoq")
family("rat_notes", "notes")


def one_segment(name: str, segment: str, families: tuple[str, ...], doc: str):
    def build(t):
        rows, codes = segment_facts(t, segment)
        return r.financial_ratios(rows, segment, families, codes)

    build.__doc__ = doc
    query(
        name,
        ratio_sql.families_sql(families, (segment,)),
        "statement prices",
        ratio_sql.facts_views(_TRAILING, False),
    )(build)


one_segment("rat_itr", "corp", ("turnover",), "Inventory turnover of companies.")
one_segment("rat_cof", "bank", ("turnover",), "Cost of funds of banks.")


_ALL = [f for f in r.DEFAULT_FAMILIES]
_FINISHED = f"""
    SELECT DISTINCT a.stock_code, a.year, a.quarter, n.ratio_code, coalesce(a.data, 0) AS data, d.segment, a.data IS NULL AS undefined,
        a.function_name
    FROM every_ratio a JOIN names n USING (function_name)
    JOIN (SELECT DISTINCT stock_code, year, quarter, segment FROM statement) d USING (stock_code, year, quarter)
    WHERE NOT (a.quarter = 0 AND n.ratio_code LIKE '%TTM%')"""
_EXTRA = ratio_sql.facts_views(_TRAILING, True) | {
    "names": ratio_sql.names_values(),
    "every_ratio": ratio_sql.families_sql(_ALL),
    "finished": _FINISHED,
}
_DATE = "strftime(make_date(year, CASE WHEN quarter = 0 THEN 12 ELSE quarter * 3 END, 30), '%Y-%m-%d') AS date_added"


@query(
    "rat_assemble",
    f"SELECT stock_code, year, quarter, ratio_code, data, {_DATE}, segment FROM finished",
    "statement prices",
    _EXTRA,
)
def rat_assemble(t):
    """Finished ratio rows of all segments."""
    stored, codes = stored_facts(t)
    parts = [
        ratio_tables.segment_ratios(stored[s], s, codes=codes[s]).drop("family") for s in SEGMENTS
    ]
    return st.stacked(*parts).withColumn("date_added", F.date_format("date_added", "yyyy-MM-dd"))


_MEMBERS = """
    SELECT industry, year, quarter, stock_code FROM (
      SELECT industry, year, quarter, stock_code, row_number() OVER (
        PARTITION BY industry, year, quarter ORDER BY data DESC, stock_code) AS rank
      FROM statement JOIN (SELECT stock_code, industry FROM companies) USING (stock_code)
      WHERE category_code = 'BS_400') WHERE rank <= {top}"""


@query(
    "agg4",
    f"""SELECT industry, year, quarter, ratio_code, round(avg(data), 6) AS data_mean, {_DATE}
    FROM finished JOIN members USING (stock_code, year, quarter) GROUP BY ALL""",
    "statement prices companies",
    _EXTRA | {"members": _MEMBERS.format(top=15)},
)
def agg4(t):
    """Mean ratios of the fifteen largest companies of each industry, all segments."""
    stored, codes = stored_facts(t)
    means = ratio_tables.industry_means(stored, t.companies, codes=codes)
    return means.withColumns(
        {"data_mean": F.round("data_mean", 6), "date_added": F.date_format("date_added", "yyyy-MM-dd")}
    )


_IND = """SELECT industry AS stock_code, year, quarter, ratio_code, round(avg(data), 6) AS data, {date}, 'industry' AS segment
    FROM finished JOIN members USING (stock_code, year, quarter) GROUP BY ALL"""


def as_compared(rows):
    return rows.withColumns(
        {"data": F.round("data", 6), "date_added": F.date_format("date_added", "yyyy-MM-dd")}
    )


@query(
    "rat_ind",
    _IND.format(date=_DATE),
    "statement prices companies",
    _EXTRA | {"members": _MEMBERS.format(top=15)},
)
def rat_ind(t):
    """Industry means as rows of the ratio table."""
    stored, codes = stored_facts(t)
    return as_compared(ratio_tables.industry_rows(stored, t.companies, codes=codes))


@query(
    "job6",
    f"""SELECT segment, ratio_code, count(*) AS rows, count(DISTINCT stock_code) AS entities,
        min(round(data, 6)) AS lowest, max(round(data, 6)) AS highest FROM (
        SELECT stock_code, ratio_code, data, segment FROM finished
        UNION ALL SELECT stock_code, ratio_code, data, segment FROM ({_IND.format(date=_DATE)}))
    GROUP BY segment, ratio_code""",
    "statement prices companies",
    _EXTRA | {"members": _MEMBERS.format(top=15)},
)
def job6(t):
    """Statements, trailing rows, ratios and industry means end to end; summary per ratio."""
    stored, codes = stored_facts(t)
    table = as_compared(ratio_tables.ratio_table(stored, t.companies, codes=codes))
    return table.groupBy("segment", "ratio_code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("stock_code").alias("entities"),
        F.min("data").alias("lowest"),
        F.max("data").alias("highest"),
    )
