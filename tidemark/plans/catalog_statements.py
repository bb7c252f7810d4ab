"""Statement queries: range reads, clean-up, mapping, growth windows, industries, lookups."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import measures, periods
from tidemark.functions import text as tx
from tidemark.operators import growth, lookup, quality, series
from tidemark.operators import statements as st
from tidemark.operators.ratios import account_frame, financial_ratios, with_ratio_codes
from tidemark.plans import statement_tables
from tidemark.plans.derived_views import base_codes
from tidemark.plans.registry import query
from tidemark.sources.workspace import new_folder

FACT = "stock_code, category_code, year, quarter, data"


def dates(df, column="date_added"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


def facts(t):
    return t.statement.select("stock_code", "category_code", "year", "quarter", "data")


DATE_ADDED = "strftime(date_added, '%Y-%m-%d') AS date_added"


# -- range reads --------------------------------------------------------------------


@query(
    "flt7",
    """SELECT year, quarter, data FROM statement WHERE stock_code = 'S12' AND category_code = 'BS_300'
        AND quarter <> 0 AND year * 10 + quarter BETWEEN 19962 AND 20003""",
    "statement",
)
def flt7(t):
    """One account by quarter between two dates."""
    return st.period_range(t.statement, "S12", "category_code", "BS_300", "1996-05-10", "2000-09-30")


@query(
    "flt8",
    """SELECT year, quarter, data FROM statement WHERE stock_code = 'S12' AND category_code = 'BS_300'
        AND quarter = 0 AND year BETWEEN 1996 AND 1999""",
    "statement",
)
def flt8(t):
    """One account by year, clamped to a limit date."""
    return st.period_range(
        t.statement, "S12", "category_code", "BS_300", "1996-05-10", "2001-09-30", "year", "1999-12-31"
    )


@query(
    "flt9",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST((month(o_orderdate) - 1) // 3 + 1 AS INTEGER) AS quarter FROM orders""",
)
def flt9(t):
    """Fiscal year and quarter of a date."""
    return t["orders"].select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
    )


@query(
    "flt10",
    f"""SELECT {FACT} FROM statement WHERE (category_code LIKE 'IS%' OR category_code LIKE 'CF%')
        AND category_code NOT IN ('IS_004', 'IS_005', 'IS_006', 'IS_007', 'IS_023', 'IS_025', 'CF_002', 'CF_024', 'CF_025', 'CF_038')""",
    "statement",
)
def flt10(t):
    """Accounts with a trailing form: by code prefix, without the listed ones."""
    return facts(t).where(st.ttm_candidates(F.col("category_code")))


@query(
    "flt11",
    """SELECT stock_code, company_name, company_name || ' of' || industry AS combine_profile, industry, exchange
    FROM companies WHERE stock_code = 'S7'""",
    "companies",
)
def flt11(t):
    """Detail of one company with cleaned profile."""
    return lookup.company_detail(t.companies, "S7")


_PART_DIM = """SELECT 'P' || p_partkey AS category_code, p_name AS category_name FROM part"""


def part_dim(t):
    return t["part"].select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("category_code"),
        F.col("p_name").alias("category_name"),
    )


@query(
    "flt12",
    """SELECT r.word AS requested, d.category_code, d.category_name
    FROM (SELECT DISTINCT split_part(category_name, ' ', 2) AS word FROM dim) r
    JOIN dim d ON list_contains(string_split(d.category_name, ' '), r.word)
    WHERE r.word NOT IN (SELECT category_code FROM dim)""",
    extra={"dim": _PART_DIM},
)
def flt12(t):
    """Requested codes that do not exist, with the codes they resemble."""
    dim = part_dim(t)
    words = dim.select(F.element_at(F.split("category_name", " "), 2).alias("category_code"))
    requested = words.unionByName(dim.select("category_code"))
    return lookup.suggestions(requested, dim, "category_code", "category_name")


# -- clean-up ---------------------------------------------------------------------------

_RAW = """
    SELECT stock_code, category_code, CASE WHEN quarter = 0 THEN '' ELSE 'Q' || quarter || '/' END || year AS time,
        data + extra AS data FROM statement, (SELECT unnest([0, 1]) AS extra)"""


def period_label():
    quarter, year = F.col("quarter").cast("string"), F.col("year").cast("string")
    return F.when(F.col("quarter") == 0, year).otherwise(
        F.concat(F.lit("Q"), quarter, F.lit("/"), year)
    )


def period_labels(t):
    """Labels of all periods with lines, five a year: looked up in the lines' dates alone."""
    days = t["lineitem"].select(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q"))
    periods_ = days.distinct().select("year", F.explode(F.array("q", F.lit(0))).alias("quarter"))
    return sorted({r[0] for r in periods_.select(period_label()).collect()}, key=str)


def raw(t):
    """Rows as a converter leaves them: period labels, every key twice."""
    return t.statement.select(
        "stock_code",
        "category_code",
        period_label().alias("time"),
        F.explode(F.array(F.col("data"), F.col("data") + 1)).alias("data"),
    )


@query(
    "flt13",
    "SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) WHERE b IS NOT NULL",
)
def flt13(t):
    """Rows without a value dropped."""
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return st.drop_empty(t["customer"].select("c_custkey", balance.alias("b")), "b")


@query("flt14", f"SELECT {FACT} FROM statement WHERE year >= 1998", "statement")
def flt14(t):
    """Rows from a first year on."""
    return st.from_year(facts(t), 1998)


@query(
    "flt15",
    "SELECT data AS amount, stock_code, category_code AS bank_code FROM statement WHERE segment = 'bank'",
    "statement",
)
def flt15(t):
    """Columns renamed, dropped and reordered."""
    rows = t.segment_statement("bank").withColumnsRenamed({"category_code": "bank_code", "data": "amount"})
    return rows.drop("date_added", "segment", "year", "quarter").select("amount", "stock_code", "bank_code")


@query(
    "flt16",
    "SELECT country, value, 'monthly' AS duration, 'Percentage' AS unit FROM macro",
    "macro",
)
def flt16(t):
    """Constant columns."""
    return st.labelled(t.macro.select("country", "value"), duration="monthly", unit="Percentage")


@query(
    "flt17",
    """SELECT l_orderkey, l_linenumber, l_quantity,
        coalesce(CASE WHEN l_returnflag = 'A' THEN 'shared' END, l_linestatus) AS category_code FROM lineitem""",
)
def flt17(t):
    """Shared code used where there is one."""
    rows = t["lineitem"].select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.col("l_linestatus").alias("category_code"),
        F.when(F.col("l_returnflag") == "A", "shared").alias("share_code"),
    )
    return st.shared_code(rows).drop("share_code")


@query(
    "flt18",
    """SELECT 'Bank_P' || p_partkey AS category_code, '(Balance sheet) ' || p_name AS en_caption FROM part""",
)
def flt18(t):
    """Prefixes of note codes and captions."""
    return part_dim(t).select(
        F.concat(F.lit(st.NOTE_PREFIX["bank"]), "category_code").alias("category_code"),
        F.concat(F.lit(st.CAPTION_PREFIX["BS"]), "category_name").alias("en_caption"),
    )


@query(
    "flt19",
    "SELECT stock_code, category_code, split_part(category_code, '_', 1) AS source, year, quarter FROM statement",
    "statement",
)
def flt19(t):
    """Statement an account belongs to."""
    return t.statement.select(
        "stock_code", "category_code", st.statement_of(F.col("category_code")).alias("source"), "year", "quarter"
    )


@query(
    "flt20",
    """SELECT stock_code, category_code, time, CAST(coalesce(nullif(regexp_extract(time, '^Q(\\d)/', 1), ''), '0') AS INTEGER) AS quarter,
        CAST(right(time, 4) AS INTEGER) AS year, data FROM raw""".replace("\\\\", "\\"),
    "statement",
    {"raw": _RAW},
)
def flt20(t):
    """Period labels parsed."""
    parsed = periods.parse_period(F.col("time"))
    return raw(t).select(
        "stock_code", "category_code", "time", parsed["quarter"].alias("quarter"), parsed["year"].alias("year"), "data"
    )


@query(
    "flt21",
    f"SELECT {FACT}, {DATE_ADDED} FROM statement",
    "statement",
)
def flt21(t):
    """Synthetic date of a period."""
    stamp = periods.period_stamp(F.col("year"), F.col("quarter"))
    return facts(t).withColumn("date_added", F.date_format(stamp, "yyyy-MM-dd"))


@query(
    "flt22",
    """SELECT stock_code, year, quarter, ratio_code, data FROM (
        SELECT stock_code, year, quarter, category_code || CASE WHEN category_code LIKE 'IS%' THEN 'TTM' ELSE '' END AS ratio_code, data
        FROM statement) WHERE NOT (quarter = 0 AND ratio_code LIKE '%TTM%')""",
    "statement",
)
def flt22(t):
    """Trailing ratios dropped on annual rows."""
    suffix = F.when(F.startswith("category_code", F.lit("IS")), "TTM").otherwise("")
    rows = facts(t).select(
        "stock_code", "year", "quarter", F.concat("category_code", suffix).alias("ratio_code"), "data"
    )
    return st.without_annual_ttm(rows)


@query(
    "flt23",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders""",
)
def flt23(t):
    """Values renamed by a lookup map."""
    from tidemark.operators.datasets import renamed

    names = {"F": "filled", "O": "open"}
    return t["orders"].select("o_orderkey", renamed(F.col("o_orderstatus"), names).alias("status"))


_UNITS = {"Inflation_%": (1.0, "Percentage"), "Unemployment_%": (1e9, "Billion")}


@query(
    "flt24",
    """SELECT country, strftime(datetime, '%Y-%m-%d') AS datetime, indicator_name,
        value / CASE indicator_name WHEN 'Inflation_%' THEN 1.0::DOUBLE ELSE 1e9 END AS value,
        CASE indicator_name WHEN 'Inflation_%' THEN 'Percentage' ELSE 'Billion' END AS unit FROM macro""",
    "macro",
)
def flt24(t):
    """Values divided by their indicator's unit."""
    rows = [(name, *unit) for name, unit in _UNITS.items()]
    units = t.spark.createDataFrame(rows, "indicator_name string, divisor double, unit string")
    scaled = t.macro.join(units, "indicator_name").withColumn("value", F.col("value") / F.col("divisor"))
    return dates(scaled.drop("divisor"), "datetime")


@query(
    "flt25",
    "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS b FROM customer",
)
def flt25(t):
    """Missing values set to 0."""
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t["customer"].select("c_custkey", balance.alias("b")).fillna(0.0, subset=["b"])


# -- joins -------------------------------------------------------------------------------

_MAPPING = """
    SELECT category_code AS own, 'U_' || category_code AS category_code
    FROM (SELECT DISTINCT category_code FROM statement) WHERE substr(md5(category_code), 1, 1) < 'c'"""


def mapping(t):
    """Universal codes for most of the account codes found in the statements."""
    codes = t.statement.select("category_code").distinct().where(F.substring(F.md5("category_code"), 1, 1) < "c")
    own = F.col("category_code")
    return codes.select(
        own.alias("corp_code"), own.alias("bank_code"), own.alias("sec_code"),
        F.concat(F.lit("U_"), own).alias("category_code"),
    )


@query(
    "jn1",
    """SELECT s.stock_code, s.year, s.quarter, s.data, m.category_code FROM statement s
    LEFT JOIN mapping m ON s.category_code = m.own WHERE s.segment IN ('securities', 'bank')""",
    "statement",
    {"mapping": _MAPPING},
)
def jn1(t):
    """Facts under universal codes, unmapped ones kept with a null code."""
    codes = mapping(t)
    parts = [
        st.to_universal(t.segment_statement(s), codes, own)
        for s, own in (("securities", "sec_code"), ("bank", "bank_code"))
    ]
    return st.stacked(*parts).select("stock_code", "year", "quarter", "data", "category_code")


@query(
    "jn2",
    """SELECT s.stock_code, s.year, s.quarter, s.data, m.category_code
    FROM (SELECT * FROM statement WHERE segment IN ('corp', 'bank')) s FULL JOIN mapping m ON s.category_code = m.own
    WHERE s.data IS NOT NULL AND m.category_code IS NOT NULL""",
    "statement",
    {"mapping": _MAPPING},
)
def jn2(t):
    """Facts under universal codes, what has no entity or no code dropped."""
    codes = mapping(t)
    parts = [
        st.to_universal(t.segment_statement(s), codes, f"{s}_code", keep_unmapped=False) for s in ("corp", "bank")
    ]
    return st.stacked(*parts).select("stock_code", "year", "quarter", "data", "category_code")


_AVERAGED = """
    SELECT stock_code, year, quarter, (data + coalesce(lag(data) OVER (
        PARTITION BY stock_code, quarter = 0 ORDER BY year, quarter), 0)) / 2 AS average_data
    FROM statement WHERE category_code = 'BS_300'"""


@query(
    "jn3",
    """SELECT a.stock_code, a.year, a.quarter, average_data, f.data AS flow
    FROM averaged a JOIN statement f ON f.stock_code = a.stock_code AND f.year = a.year
      AND f.quarter = a.quarter AND f.category_code = 'BS_400'""",
    "statement",
    {"averaged": _AVERAGED},
)
def jn3(t):
    """Average balance next to another account of the same period."""
    frame = account_frame(t.statement, ["BS_300", "BS_400"])
    mean = growth.previous_row_average(F.col("a_BS_300"), growth.run_window())
    rows = frame.withColumn("average_data", mean)
    return rows.where(F.col("average_data").isNotNull() & F.col("a_BS_400").isNotNull()).select(
        "stock_code", "year", "quarter", "average_data", F.col("a_BS_400").alias("flow")
    )


@query(
    "jn4",
    f"SELECT {FACT}, industry FROM statement LEFT JOIN (SELECT stock_code, industry FROM companies) USING (stock_code)",
    "statement companies",
)
def jn4(t):
    """Industry of each fact's entity."""
    return st.with_industry(facts(t), t.companies)


_INCOME = """
    SELECT stock_code, year, quarter, 'financial_income_to_net_revenue_ratio' AS function_name,
        sum(data) FILTER (category_code = 'IS_021') / nullif(sum(data) FILTER (category_code = 'IS_010'), 0) AS data
    FROM statement WHERE segment = 'corp' GROUP BY stock_code, year, quarter"""


@query(
    "jn5",
    """SELECT i.*, d.date_added FROM income i JOIN (SELECT DISTINCT stock_code, year, quarter,
        strftime(date_added, '%Y-%m-%d') AS date_added FROM statement) d USING (stock_code, year, quarter)""",
    "statement",
    {"income": _INCOME},
)
def jn5(t):
    """Date of the period attached to ratios."""
    rows = financial_ratios(t.segment_statement("corp"), "corp", ("income",)).drop("family")
    return dates(st.with_period_dates(rows, t.statement))


@query(
    "jn6",
    """SELECT *, 'FITNRR' AS ratio_code, 'Financial Income To Net Revenue Ratio' AS ratio_name FROM income""",
    "statement",
    {"income": _INCOME},
)
def jn6(t):
    """Code and name attached to ratios."""
    return with_ratio_codes(
        financial_ratios(t.segment_statement("corp"), "corp", ("income",)).drop("family")
    )


_LARGEST = """
    SELECT industry, year, quarter, stock_code, CAST(rank AS INTEGER) AS rank FROM (
      SELECT industry, year, quarter, stock_code, row_number() OVER (
        PARTITION BY industry, year, quarter ORDER BY data DESC, stock_code) AS rank
      FROM statement JOIN (SELECT stock_code, industry FROM companies) USING (stock_code)
      WHERE category_code = 'BS_400') WHERE rank <= 3"""


@query(
    "jn7",
    f"""SELECT {', '.join('s.' + c for c in FACT.split(', '))}, industry
    FROM statement s JOIN largest l USING (stock_code, year, quarter)""",
    "statement companies",
    {"largest": _LARGEST},
)
def jn7(t):
    """Facts of the largest entities of each industry and period."""
    members = st.largest_entities(t.statement, t.companies, top=3).drop("rank")
    return facts(t).join(members, ["year", "quarter", "stock_code"])


@query(
    "jn8",
    """SELECT a.stock_code, a.year, a.quarter, a.data, b.data AS prior
    FROM (SELECT * FROM statement WHERE category_code = 'BS_300') a
    LEFT JOIN (SELECT * FROM statement WHERE category_code = 'BS_300') b
      ON b.stock_code = a.stock_code AND b.year = a.year - 1 AND b.quarter = a.quarter""",
    "statement",
)
def jn8(t):
    """Same period of the year before."""
    rows = t.statement.where(F.col("category_code") == "BS_300")
    return rows.select(
        "stock_code", "year", "quarter", "data", growth.same_period_last_year(F.col("data")).alias("prior")
    )


@query(
    "jn9",
    """SELECT subject, industry, CAST(place AS INTEGER) AS place, peer FROM (
      SELECT c.stock_code AS subject, c.industry, p.stock_code AS peer, row_number() OVER (
        PARTITION BY c.stock_code ORDER BY p.issue_share DESC, p.stock_code) AS place
      FROM companies c JOIN companies p ON p.industry = c.industry AND p.stock_code <> c.stock_code)
    WHERE place <= 5""",
    "companies",
)
def jn9(t):
    """Five largest peers of every company."""
    return lookup.all_similar_companies(t.companies)


@query(
    "jn9_one",
    """SELECT stock_code, company_name, industry, exchange FROM companies
    WHERE industry = (SELECT industry FROM companies WHERE stock_code = 'S3') AND stock_code <> 'S3'
    ORDER BY issue_share DESC, stock_code LIMIT 5""",
    "companies",
)
def jn9_one(t):
    """Five largest peers of one company."""
    return lookup.similar_companies(t.companies, "S3")


@query(
    "jn11",
    f"SELECT {FACT} FROM statement WHERE stock_code IN (SELECT stock_code FROM companies WHERE exchange = 'ASIA')",
    "statement companies",
)
def jn11(t):
    """Facts of the companies of one exchange."""
    chosen = t.companies.where(F.col("exchange") == "ASIA").select("stock_code")
    return facts(t).join(chosen, "stock_code", "left_semi")


@query(
    "jn13",
    """SELECT category_code, 'mapping' AS missing_in FROM (SELECT DISTINCT category_code FROM statement)
      WHERE category_code NOT IN (SELECT own FROM mapping)
    UNION ALL SELECT 'U_' || own, 'fact' FROM mapping""",
    "statement",
    {"mapping": _MAPPING},
)
def jn13(t):
    """Codes found in the facts or in the mapping only."""
    m = mapping(t)
    both = m.select("category_code").unionByName(m.select(F.col("corp_code").alias("category_code")))
    return quality.reconciliation(t.statement, both)


_TEMPLATE = [("R1", "user "), ("R2", "assistant"), ("R3", " user"), ("R4", "assistant"), ("R5", "system")]


@query(
    "jn14",
    """SELECT conv_id, turn, role, code AS category_code FROM w""",
    "",
    {
        "e": "SELECT * FROM (VALUES (0,'R1','user'),(1,'R2','assistant'),(2,'R3','user'),(3,'R4','assistant'),(4,'R5','system')) v(i, code, caption)",
        "o": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations",
        "w": """SELECT * FROM (WITH RECURSIVE r(conv_id, turn, role, rn, nxt, code) AS (
            SELECT conv_id, turn, role, rn, CASE WHEN role = 'user' THEN 1 ELSE 0 END, CASE WHEN role = 'user' THEN 'R1' END
            FROM o WHERE rn = 1
            UNION ALL
            SELECT o.conv_id, o.turn, o.role, o.rn, r.nxt + CASE WHEN e.caption = o.role THEN 1 ELSE 0 END,
              CASE WHEN e.caption = o.role THEN e.code END
            FROM r JOIN o ON o.conv_id = r.conv_id AND o.rn = r.rn + 1 LEFT JOIN e ON e.i = r.nxt)
            SELECT * FROM r)""",
    },
)
def jn14(t):
    """Lines of a sheet aligned with an ordered template."""
    return st.aligned_captions(t["conversations"], "conv_id", "turn", "role", _TEMPLATE)


# -- aggregates -----------------------------------------------------------------------------

_CODES = ["BS_270", "BS_300", "BS_400", "IS_010", "IS_021"]


@query(
    "agg1",
    "SELECT stock_code, year, quarter, "
    + ", ".join(f"sum(data) FILTER (category_code = '{c}') AS a_{c}" for c in _CODES)
    + f" FROM statement WHERE category_code IN {tuple(_CODES)} GROUP BY ALL",
    "statement",
)
def agg1(t):
    """Accounts as columns."""
    return account_frame(t.statement, _CODES)


@query(
    "agg2",
    f"""SELECT {FACT} FROM statement UNION ALL
    SELECT stock_code, 'BS_X', year, quarter, avg(data) FILTER (category_code = 'BS_300')
        + avg(data) FILTER (category_code = 'BS_400') - avg(data) FILTER (category_code = 'BS_220')
    FROM statement WHERE category_code IN ('BS_300', 'BS_400', 'BS_220') GROUP BY stock_code, year, quarter""",
    "statement",
)
def agg2(t):
    """A derived account appended to the facts."""
    rows = st.derived_account(t.statement, "BS_X", ["BS_300", "BS_400"], ["BS_220"])
    return rows.select("stock_code", "category_code", "year", "quarter", "data")


#: Inputs of the named derived accounts, in the order in which test accounts stand for them.
_INPUTS = {
    "bank": "BS_160 BS_180 BS_131 BS_139 BS_310 BS_320 BS_321 BS_322 BS_330 BS_340 BS_350 BS_360".split(),
    "securities": "IS_040.1 IS_050 IS_060 IS_061 IS_062".split(),
    "corp": "IS_022 IS_024 IS_025 IS_026 IS_021".split(),
    "bank_notes": "Bank_TM_68 Bank_TM_69 Bank_TM_70".split(),
}


def _segment_of(key: str) -> str:
    return key.removesuffix("_notes")


def _part(key: str, name: str, formula: str) -> str:
    """SQL of one derived account; [code] stands for that account's value."""
    value = re.sub(r"\[([^\]]+)\]", r"avg(data) FILTER (category_code = '\1')", formula)
    codes = ", ".join(f"'{c}'" for c in re.findall(r"\[([^\]]+)\]", formula))
    return (
        f"SELECT stock_code, '{name}' AS category_code, year, quarter, {value} AS data FROM relabelled "
        f"WHERE key = '{key}' AND category_code IN ({codes}) GROUP BY stock_code, year, quarter"
    )


_RELABEL = ", ".join(
    f"('{key}', '{_segment_of(key)}', '{own}', '{code}')"
    for key, codes in _INPUTS.items()
    for own, code in zip(base_codes(_segment_of(key)), codes)
)


@query(
    "agg2_named",
    " UNION ALL ".join(
        _part(*x)
        for x in (
            ("bank", "BS_200", "[BS_160] + [BS_180] - [BS_131] - [BS_139]"),
            ("bank", "BS_361", "[BS_310] + [BS_320] + [BS_321] + [BS_322] + [BS_330] + [BS_340] + [BS_350] + [BS_360]"),
            ("securities", "IS_070", "[IS_040.1] + [IS_050] - [IS_060] - [IS_061] - [IS_062]"),
            ("securities", "IS_095", "[IS_060] + [IS_061] + [IS_062] - [IS_050]"),
            ("corp", "IS_027", "[IS_022] + [IS_024] + [IS_025] + [IS_026] - [IS_021]"),
            ("bank_notes", "Bank_TM_65", "[Bank_TM_68] + [Bank_TM_69] + [Bank_TM_70]"),
        )
    ),
    "statement",
    {
        "relabelled": f"""SELECT stock_code, key, code AS category_code, year, quarter, data FROM statement
            JOIN (VALUES {_RELABEL}) AS r(key, own_segment, own, code) ON segment = own_segment AND category_code = own"""
    },
)
def agg2_named(t):
    """All named derived accounts, from facts in which every input occurs."""
    parts = []
    for key, accounts in st.DERIVED_ACCOUNTS.items():
        segment = _segment_of(key)
        names = dict(zip(base_codes(segment), _INPUTS[key]))
        pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        rows = t.segment_statement(segment).withColumn("category_code", F.try_element_at(pairs, F.col("category_code")))
        rows = rows.where(F.col("category_code").isNotNull())
        for name, (added, subtracted) in accounts.items():
            parts.append(st.derived_account(rows, name, added, subtracted).where(F.col("category_code") == name))
    return st.stacked(*parts).select("stock_code", "category_code", "year", "quarter", "data")


@query(
    "agg3",
    f"""SELECT industry, year, quarter, category_code, {DATE_ADDED}, sum(data) AS data_sum, avg(data) AS data_mean
    FROM statement JOIN (SELECT stock_code, industry FROM companies) USING (stock_code) GROUP BY ALL""",
    "statement companies",
)
def agg3(t):
    """Sum and mean per industry, period and account."""
    return dates(st.industry_statements(t.statement, t.companies))


@query(
    "agg3_means",
    f"""SELECT industry AS stock_code, category_code, avg(data) AS data, year, quarter, {DATE_ADDED}, 'industry' AS segment
    FROM statement JOIN (SELECT stock_code, industry FROM companies) USING (stock_code)
    GROUP BY industry, category_code, year, quarter, date_added""",
    "statement companies",
)
def agg3_means(t):
    """Industry means alone, as facts whose entity is the industry."""
    return dates(st.industry_mean_rows(t.statement, t.companies))


@query(
    "agg13",
    """SELECT segment, count(DISTINCT stock_code) AS n_stock_code, count(DISTINCT category_code) AS n_category_code
    FROM statement GROUP BY segment""",
    "statement",
)
def agg13(t):
    """Distinct entities and accounts per segment."""
    return quality.distinct_counts(t.statement, ["segment"], ["stock_code", "category_code"])


@query(
    "agg13_observed",
    f"""SELECT category_code, count(*) AS rows, count(*) FILTER (data IS NULL OR data < 0) AS negative,
        (SELECT count(*) FROM statement) AS checked, (SELECT CAST(max(year) AS INTEGER) FROM statement) AS last_year
    FROM (SELECT s.category_code, s.data, m.own FROM statement s LEFT JOIN mapping m ON s.category_code = own)
    WHERE own IS NULL OR data IS NULL OR data < 0 GROUP BY category_code""",
    "statement",
    {"mapping": _MAPPING},
)
def agg13_observed(t):
    """Facts stored and checked in one scan: unmapped or negative rows by code, with the observed counts."""
    known = mapping(t).select(F.col("corp_code").alias("category_code"), F.lit(True).alias("known"))
    rows = t.statement.join(known, "category_code", "left")
    seen, failing = quality.checked_write(
        rows,
        new_folder(t.spark, "agg13"),
        {"mapped": F.col("known"), "not_negative": F.col("data") >= 0},
        {"last_year": F.max("year")},
        most_failures=None,
    )
    negative = F.count_if(F.array_contains("failed", "not_negative"))
    return failing.groupBy("category_code").agg(
        F.count(F.lit(1)).alias("rows"),
        negative.alias("negative"),
        F.lit(seen["rows"]).cast("long").alias("checked"),
        F.lit(seen["last_year"]).cast("int").alias("last_year"),
    )


@query(
    "agg14",
    "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, md5(text) AS text FROM documents GROUP BY text",
)
def agg14(t):
    """First document of each text."""
    rows = st.first_per_key(t["documents"].select("text", "doc_id", "source"), ["text"], ["doc_id"])
    return rows.withColumn("text", F.md5("text"))


@query(
    "agg14_rows",
    "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem",
)
def agg14_rows(t):
    """Full rows de-duplicated."""
    return t["lineitem"].select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query(
    "agg15",
    """SELECT stock_code, year, quarter, sum(data) AS data FROM statement
    WHERE category_code IN ('BS_310', 'BS_320', 'BS_330', 'BS_340', 'BS_360') GROUP BY ALL""",
    "statement",
)
def agg15(t):
    """Several accounts added per period."""
    codes = ["BS_310", "BS_320", "BS_330", "BS_340", "BS_360"]
    rows = t.statement.where(F.col("category_code").isin(codes))
    return rows.groupBy("stock_code", "year", "quarter").agg(F.sum("data").alias("data"))


@query(
    "agg16",
    """SELECT series_key, CAST(year(time) AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, close * 1000 AS close
    FROM (SELECT *, unnest(CASE WHEN quarter(time) = 4 THEN [4, 0] ELSE [quarter(time)] END) AS q
          FROM months WHERE month(time) % 3 = 0)""",
    "months",
)
def agg16(t):
    """Quarter-end prices, the fourth also for the year."""
    return statement_tables.price_rows(t.bars, "series_key")


@query(
    "agg18",
    "SELECT count(*) AS vectors, count(DISTINCT label) AS labels FROM embeddings",
)
def agg18(t):
    """Number of stored vectors."""
    return t["embeddings"].agg(
        F.count(F.lit(1)).alias("vectors"), F.countDistinct("label").alias("labels")
    )


# -- windows ----------------------------------------------------------------------------------


@query("win5", "SELECT * FROM largest", "statement companies", {"largest": _LARGEST})
def win5(t):
    """Three largest entities per industry and period."""
    return st.largest_entities(t.statement, t.companies, top=3)


_TTM = """
    SELECT stock_code, category_code || '_TTM' AS category_code, year, quarter, ttm AS data FROM (
      SELECT *, sum(data) OVER w AS ttm, count(data) OVER w AS n,
        year * 4 + quarter - lag(year * 4 + quarter, 3) OVER (PARTITION BY stock_code, category_code ORDER BY year, quarter) AS width
      FROM {source} WHERE quarter <> 0
      WINDOW w AS (PARTITION BY stock_code, category_code ORDER BY year, quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    WHERE n = 4 {gap}"""


@query("win6", _TTM.format(source="statement", gap="AND width = 3"), "statement")
def win6(t):
    """Trailing sums over four consecutive quarters."""
    return growth.trailing_twelve_months(facts(t))


@query("win6_rows", _TTM.format(source="statement", gap=""), "statement")
def win6_rows(t):
    """Trailing sums over four rows, gaps or not."""
    return growth.trailing_twelve_months(facts(t), calendar=False)


_FRAME = "SELECT stock_code, year, quarter, sum(data) FILTER (category_code = 'BS_300') AS x FROM statement GROUP BY ALL"


def frame(t):
    """One row per entity and period, whether or not it has the account."""
    x = F.when(F.col("category_code") == "BS_300", F.col("data"))
    return t.statement.groupBy("stock_code", "year", "quarter").agg(F.sum(x).alias("x"))


@query(
    "win7",
    """SELECT a.*, (a.x - b.x) / nullif(b.x, 0) AS yoy FROM f a
    LEFT JOIN f b ON b.stock_code = a.stock_code AND b.year = a.year - 1 AND b.quarter = a.quarter""",
    "statement",
    {"f": _FRAME},
)
def win7(t):
    """Growth against the same period last year."""
    return frame(t).withColumn("yoy", growth.yearly_growth(F.col("x")))


@query(
    "win8",
    """SELECT a.*, (a.x - b.x) / nullif(b.x, 0) AS qoq FROM f a
    LEFT JOIN f b ON b.stock_code = a.stock_code AND b.quarter <> 0 AND b.year * 4 + b.quarter = a.year * 4 + a.quarter - 1
    WHERE a.quarter <> 0""",
    "statement",
    {"f": _FRAME},
)
def win8(t):
    """Growth against the quarter before."""
    rows = frame(t).withColumn("qoq", growth.quarterly_growth(F.col("x")))
    return rows.where(F.col("quarter") != 0)


@query("win9", "SELECT * FROM averaged", "statement", {"averaged": _AVERAGED})
def win9(t):
    """Mean with the previous row, the first row with 0."""
    mean = growth.previous_row_average(F.col("x"), growth.run_window())
    rows = frame(t).select("stock_code", "year", "quarter", mean.alias("average_data"))
    return st.drop_empty(rows, "average_data")


@query(
    "win10",
    """SELECT a.stock_code, a.year, a.quarter, (a.x + b.x) / 2 AS average_data FROM f a
    JOIN f b ON b.stock_code = a.stock_code AND b.year = a.year - 1 AND b.quarter = 0""",
    "statement",
    {"f": _FRAME},
)
def win10(t):
    """Mean with the prior year's annual figure, where there is one."""
    rows = frame(t).select(
        "stock_code", "year", "quarter",
        growth.annual_average(F.col("x")).alias("average_data"),
        growth.has_prior_annual().alias("known"),
    )
    return rows.where("known").drop("known")


@query(
    "win11",
    """SELECT stock_code, year, quarter, CASE WHEN n = 4 AND width = 3 THEN (first + x) / 2 END AS average_data FROM (
      SELECT *, first_value(x) OVER w AS first, count(x) OVER w AS n,
        year * 4 + quarter - lag(year * 4 + quarter, 3) OVER (PARTITION BY stock_code ORDER BY year, quarter) AS width
      FROM f WHERE quarter <> 0
      WINDOW w AS (PARTITION BY stock_code ORDER BY year, quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
    "statement",
    {"f": _FRAME},
)
def win11(t):
    """Mean of the first and last of four consecutive quarters."""
    rows = frame(t).where(F.col("quarter") != 0)
    mean = growth.trailing_average(F.col("x"), growth.run_window())
    return rows.select("stock_code", "year", "quarter", mean.alias("average_data"))


@query(
    "win14",
    f"SELECT stock_code, category_code, year, quarter, {DATE_ADDED} FROM statement WHERE quarter <> 0",
    "statement",
)
def win14(t):
    """Dates carried along unchanged."""
    rows = t.statement.where(F.col("quarter") != 0)
    return dates(rows.select("stock_code", "category_code", "year", "quarter", "date_added"))


# -- sorts, sets, scalars -------------------------------------------------------------------


@query(
    "srt4",
    f"SELECT {FACT} FROM statement ORDER BY stock_code, category_code, year, quarter",
    "statement",
)
def srt4(t):
    """Facts in entity, account and period order."""
    return facts(t).orderBy("stock_code", "category_code", "year", "quarter")


@query(
    "set2",
    """SELECT stock_code, category_code, year, quarter, data, CASE WHEN segment = 'corp' THEN 'c' END AS note
    FROM statement""",
    "statement",
)
def set2(t):
    """Segments stacked; a column only one of them has is null elsewhere."""
    pick = lambda s: t.segment_statement(s).select(
        "stock_code", "category_code", "year", "quarter", "data"
    )
    return st.stacked(pick("bank"), pick("securities"), st.labelled(pick("corp"), note="c"))


@query(
    "set3",
    """SELECT DISTINCT category_code FROM statement WHERE segment = 'bank' AND category_code NOT IN (
        SELECT category_code FROM statement WHERE segment = 'corp')""",
    "statement",
)
def set3(t):
    """Accounts of banks that companies lack."""
    return st.codes_missing(t.segment_statement("bank"), t.segment_statement("corp"))


@query(
    "scl6",
    """SELECT o_orderkey, 'YR' || year(o_orderdate) AS label, year(o_orderdate) || '-01-01' AS datetime FROM orders""",
)
def scl6(t):
    """Year labels as dates."""
    rows = t["orders"].select("o_orderkey", F.concat(F.lit("YR"), F.year("o_orderdate").cast("string")).alias("label"))
    return rows.withColumn("datetime", F.date_format(periods.year_label_date(F.col("label")), "yyyy-MM-dd"))


@query(
    "scl9",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity / nullif(l_discount, 0) AS v FROM lineitem",
)
def scl9(t):
    """Division with a divisor that may be zero."""
    v = F.col("l_quantity") / measures.null_if_zero(F.col("l_discount"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", v.alias("v"))


@query(
    "scl10",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS v FROM lineitem",
)
def scl10(t):
    """Guarded division."""
    v = measures.quotient(F.col("l_discount"), F.col("l_tax"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", v.alias("v"))


@query(
    "scl11",
    """SELECT stock_code, year, quarter, code, CASE WHEN code = 'DSO' THEN data * CASE WHEN quarter = 0 THEN 365 ELSE 90 END ELSE data END AS data
    FROM (SELECT *, CASE WHEN category_code LIKE 'BS%' THEN 'DSO' ELSE 'ROA' END AS code FROM statement)""",
    "statement",
)
def scl11(t):
    """Days ratios scaled by the length of their period."""
    code = F.when(F.startswith("category_code", F.lit("BS")), "DSO").otherwise("ROA")
    rows = facts(t).withColumn("code", code)
    days = measures.days_scaled(F.col("code"), F.col("quarter"), F.col("data"))
    return rows.select("stock_code", "year", "quarter", "code", days.alias("data"))


@query(
    "scl14",
    """SELECT company_name || ' of' || industry AS profile, stock_code FROM companies""",
    "companies",
)
def scl14(t):
    """Profiles without line breaks and no-break spaces."""
    return t.companies.select("stock_code", tx.clean_profile(F.col("combine_profile")).alias("profile"))


# -- jobs -----------------------------------------------------------------------------------------


def by_segment(t):
    return {s: t.segment_statement(s) for s in ("bank", "securities", "corp")}


@query(
    "job1",
    """SELECT s.stock_code, s.year, s.quarter, s.data, s.segment, m.category_code FROM statement s
    JOIN mapping m ON s.category_code = m.own""",
    "statement",
    {"mapping": _MAPPING},
)
def job1(t):
    """Statements of all segments under universal codes."""
    return statement_tables.universal_statements(by_segment(t), mapping(t)).drop("date_added")


@query(
    "job2",
    f"SELECT {FACT}, segment FROM statement WHERE category_code LIKE '%TM%'",
    "statement",
)
def job2(t):
    """Notes of all segments in one table."""
    notes = [d.where(F.col("category_code").contains("TM")) for d in by_segment(t).values()]
    return statement_tables.merged_notes(notes).drop("date_added")


_ELIGIBLE = """
    SELECT * FROM statement WHERE (category_code LIKE 'IS%' OR category_code LIKE 'CF%')
        AND category_code NOT IN ('IS_004', 'IS_005', 'IS_006', 'IS_007', 'IS_023', 'IS_025', 'CF_002', 'CF_024', 'CF_025', 'CF_038')"""


@query(
    "job3",
    f"SELECT {FACT} FROM statement UNION ALL " + _TTM.format(source="eligible", gap="AND width = 3"),
    "statement",
    {"eligible": _ELIGIBLE},
)
def job3(t):
    """Statements with trailing rows."""
    rows = statement_tables.with_trailing_rows(t.statement)
    return rows.select("stock_code", "category_code", "year", "quarter", "data")


@query(
    "job4",
    """SELECT category_code, bank_code, en_caption FROM d UNION ALL
    SELECT category_code || '_TTM', bank_code || '_TTM', en_caption || ' (Trailing Twelve Months)' FROM d
    WHERE category_code LIKE 'IS%' AND category_code NOT IN ('IS_004', 'IS_005', 'IS_006', 'IS_007', 'IS_022',
      'IS_023', 'IS_024', 'IS_025', 'IS_041', 'IS_046', 'IS_047', 'IS_048', 'IS_081', 'IS_082')""",
    "",
    {
        "d": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'IS_' ELSE 'BS_' END || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') AS category_code,
            CASE WHEN p_partkey % 3 > 0 THEN 'B' || p_partkey END AS bank_code, p_name AS en_caption FROM part"""
    },
)
def job4(t):
    """Code dimension with trailing forms; missing parts stay missing."""
    key = F.col("p_partkey")
    prefix = F.when(key % 2 == 0, "IS_").otherwise("BS_")
    dim = t["part"].select(
        F.concat(prefix, F.lpad((key % 100).cast("string"), 3, "0")).alias("category_code"),
        F.when(key % 3 > 0, F.concat(F.lit("B"), key.cast("string"))).alias("bank_code"),
        F.col("p_name").alias("en_caption"),
    )
    return st.with_ttm_codes(dim, ["bank_code"], ["en_caption"])


@query(
    "job5",
    """SELECT segment, count(DISTINCT stock_code) AS companies FROM (
        SELECT segment, stock_code FROM statement
        UNION ALL SELECT 'bank', 'C' || c_custkey FROM customer) GROUP BY segment""",
    "statement",
)
def job5(t):
    """Company universe, extended, with its distinct counts."""
    more = t["customer"].select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("stock_code"))
    _, counts = statement_tables.company_universe(by_segment(t), {"bank": more})
    return counts


@query(
    "job7",
    """SELECT 'P' || p_partkey AS category_code, p_name AS category_name FROM part
    UNION ALL SELECT p_type, '(Explaination) ' || min(p_name) FROM part GROUP BY p_type""",
)
def job7(t):
    """Code dimension from standard and note captions."""
    notes = t["part"].select(F.col("p_type").alias("category_code"), F.col("p_name").alias("en_caption"))
    return statement_tables.account_dimension(part_dim(t), notes)


@query(
    "job8",
    """SELECT year(o_orderdate) || '-01-01' AS datetime, 'annually' AS duration, 'Orders' AS indicator_name,
        n_name AS country, count(*) / 1e3 AS value, 'Thousand' AS unit
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def job8(t):
    """Macro table from one column per year."""
    label = F.concat(F.lit("YR"), F.year("o_orderdate").cast("string"))
    rows = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("country"), label.alias("label"))
    )
    wide = rows.groupBy("country").pivot("label").agg(F.sum(F.lit(1.0)))
    long = statement_tables.macro_from_wide(wide, "Orders", 1e3, "Thousand")
    return dates(st.drop_empty(long, "value"), "datetime")


@query(
    "job8_yields",
    """SELECT strftime(time, '%Y-%m-%d') AS datetime, 'monthly' AS duration, n AS indicator_name, 'USA' AS country,
        v AS value, 'Percentage' AS unit
    FROM (SELECT last_day(time) AS time, unnest(['USA_2Y', 'USA_10Y']) AS n,
          unnest([avg(close) FILTER (series_key = '2-HIGH'), avg(close) FILTER (series_key = '5-LOW')]) AS v
          FROM bars GROUP BY last_day(time))""",
    "bars",
)
def job8_yields(t):
    """Monthly yields from one column per maturity."""
    wide = t.bars.groupBy("time").agg(
        F.max(F.when(F.col("series_key") == "2-HIGH", F.col("close"))).alias("2Y"),
        F.max(F.when(F.col("series_key") == "5-LOW", F.col("close"))).alias("10Y"),
    )
    monthly = series.month_end_mean(wide, [], "time", ["2Y", "10Y"])
    return dates(statement_tables.yields_from_wide(monthly, "time"), "datetime")


@query(
    "job9",
    f"SELECT {FACT}, {DATE_ADDED} FROM statement",
    "statement",
)
def job9(t):
    """Sheet with a column per period turned into dated rows."""
    wide = raw(t).groupBy("stock_code", "category_code").pivot("time", period_labels(t)).agg(F.min("data"))
    rows = wide.withColumn("Triệu VND", F.lit(0.0))
    long = st.drop_empty(st.wide_to_long(rows, ["stock_code", "category_code"]), "data")
    return dates(st.with_period(long))


@query(
    "job9_clean",
    f"""SELECT {FACT}, {DATE_ADDED}, segment FROM statement WHERE segment = 'bank' AND year >= 1997""",
    "statement",
)
def job9_clean(t):
    """Raw rows of the banks made into facts: first value per key, dates, old years and empty values away.

    The test accounts lack inputs of the banks' derived accounts, which ``agg2_named`` covers.
    """
    banks = t.companies.where(F.col("segment") == "bank").select("stock_code")
    return dates(
        statement_tables.cleaned_statements(raw(t).join(banks, "stock_code", "left_semi"), "bank", 1997)
    )
