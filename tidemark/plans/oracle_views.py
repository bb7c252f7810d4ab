"""The tables of ``derived_views`` once more, as SQL for the comparison engine."""

from __future__ import annotations

from tidemark.plans.derived_views import SEGMENTS, base_codes


def _accounts() -> str:
    rows = [
        f"('{s}', {i}, '{c}')" for s in SEGMENTS for i, c in enumerate(base_codes(s))
    ]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS v(segment, slot, category_code)"


def _account_slots() -> str:
    cases = " ".join(f"WHEN '{s}' THEN {len(base_codes(s))}" for s in SEGMENTS)
    return f"CASE segment {cases} END"


def averages(source: str, spans, key: str = "series_key", value: str = "close") -> str:
    """Recursive view of exponential averages over ``source``."""
    names = ", ".join(f"e{s}" for s in spans)
    first = ", ".join(value for _ in spans)
    step = ", ".join(
        f"a.e{s} + (CAST(2 AS DOUBLE) / {s + 1}) * (n.{value} - a.e{s})" for s in spans
    )
    return f"""
        SELECT n.*, {', '.join(f'a.e{s} AS "EMA{s}"' for s in spans)}
        FROM {source}_n n JOIN (
            WITH RECURSIVE a(k, rn, {names}) AS (
                SELECT {key}, rn, {first} FROM {source}_n WHERE rn = 1
                UNION ALL
                SELECT n.{key}, n.rn, {step}
                FROM a JOIN {source}_n n ON n.{key} = a.k AND n.rn = a.rn + 1)
            SELECT * FROM a) a ON a.k = n.{key} AND a.rn = n.rn"""


_DAY = "CAST(o_orderdate AS DATE)"
_DOC_TIME = (
    "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({d} % 365 AS INTEGER))"
    " + to_hours(CAST({d} % 24 AS INTEGER))"
)

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (
        (),
        f"""SELECT o_orderpriority AS series_key, {_DAY} AS time,
            arg_max(x, o_orderkey) AS close, arg_min(x, o_orderkey) AS open,
            max(x) AS high, min(x) AS low, count(*) AS volume
        FROM (SELECT *, round(o_totalprice * 100) AS x FROM orders) GROUP BY ALL""",
    ),
    "bars_n": (
        ("bars",),
        "SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY time) AS rn FROM bars",
    ),
    "stock_daily": (("bars_n",), averages("bars", (20, 50, 200))),
    "months": (
        ("bars",),
        """SELECT series_key, last_day(time) AS time, arg_max(close, time) AS close,
            arg_max(volume, time) AS volume FROM bars GROUP BY ALL""",
    ),
    "months_n": (
        ("months",),
        "SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY time) AS rn FROM months",
    ),
    "stock_monthly": (("months_n",), averages("months", (12, 26))),
    "commodity": (
        (),
        """SELECT event_type AS indicator_code,
            upper(event_type[1]) || event_type[2:] AS indicator_name, CAST(ts AS DATE) AS time,
            arg_min(x, event_id) AS open, max(x) AS high, min(x) AS low,
            arg_max(x, event_id) AS close, count(*) AS volume
        FROM (SELECT *, round(value * 100) AS x FROM events) GROUP BY ALL""",
    ),
    "commodity_n": (
        ("commodity",),
        "SELECT *, row_number() OVER (PARTITION BY indicator_code ORDER BY time) AS rn FROM commodity",
    ),
    "commodity_daily": (
        ("commodity_n",),
        averages("commodity", (20, 50), "indicator_code"),
    ),
    "commodity_months": (
        ("commodity",),
        """SELECT indicator_code, indicator_name, last_day(time) AS time, arg_min(open, time) AS open,
            max(high) AS high, min(low) AS low, arg_max(close, time) AS close,
            CAST(sum(volume) AS BIGINT) AS volume FROM commodity GROUP BY ALL""",
    ),
    "commodity_months_n": (
        ("commodity_months",),
        """SELECT *, row_number() OVER (PARTITION BY indicator_code ORDER BY time) AS rn
        FROM commodity_months""",
    ),
    "commodity_monthly": (
        ("commodity_months_n",),
        averages("commodity_months", (12, 26), "indicator_code"),
    ),
    "macro_wide": (
        (),
        f"""SELECT n_name AS country, CAST(date_trunc('month', o_orderdate) AS DATE) AS datetime,
            CAST(count(*) AS DOUBLE) AS c, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS t
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL""",
    ),
    "macro": (
        ("macro_wide",),
        """SELECT country, datetime, 'Inflation_%' AS indicator_name, c AS value FROM macro_wide
        UNION ALL SELECT country, datetime, 'Unemployment_%', t FROM macro_wide""",
    ),
    "companies": (
        (),
        r"""SELECT 'S' || s_suppkey AS stock_code, s_name AS company_name,
            ' ' || s_name || chr(160) || 'of' || chr(10) || n_name || ' ' AS combine_profile,
            n_name AS industry, r_name AS exchange, round(s_acctbal * 100) AS issue_share,
            CASE s_nationkey % 3 WHEN 0 THEN 'corp' WHEN 1 THEN 'bank' ELSE 'securities' END AS segment
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "accounts": ((), _accounts()),
    "slots": (
        (),
        """SELECT 'S' || l_suppkey AS stock_code, CAST(year(l_shipdate) AS INTEGER) AS year,
            CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
            CASE s_nationkey % 3 WHEN 0 THEN 'corp' WHEN 1 THEN 'bank' ELSE 'securities' END AS segment,
            (l_linenumber - 1) * 12 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 4
              + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END * 2 + CAST(l_quantity AS BIGINT) % 2 AS raw,
            CAST(round(l_extendedprice * 100) AS BIGINT) AS x
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "statement": (
        ("slots", "accounts"),
        f"""SELECT stock_code, category_code, year, quarter, segment, CAST(sum(x) AS DOUBLE) AS data,
            make_date(year, CASE WHEN quarter = 0 THEN 12 ELSE quarter * 3 END, 30) AS date_added
        FROM (SELECT * REPLACE (u.quarter AS quarter), raw % {_account_slots()} AS slot
              FROM (SELECT * FROM slots UNION ALL SELECT * REPLACE (0 AS quarter) FROM slots) u)
        JOIN accounts USING (segment, slot) GROUP BY ALL""",
    ),
    "prices": (
        ("slots",),
        """SELECT stock_code, year, q AS quarter, CAST(max(x) AS DOUBLE) AS close
        FROM (SELECT stock_code, year, unnest([quarter, 0]) AS q, x FROM slots) GROUP BY ALL""",
    ),
    "news": (
        (),
        rf"""SELECT 'doc://' || doc_id AS url, source, regexp_extract(text, '^[^.!?\n]*') AS title,
            {_DOC_TIME.format(d='doc_id')} AS pub_date, lang AS channel_name,
            CAST(source[4:] AS BIGINT) AS channel_id, text FROM documents""",
    ),
    "points": (
        (),
        f"""SELECT vec_id, 'doc://' || (vec_id // 2) AS url, vec_id % 2 AS chunk_index,
            {_DOC_TIME.format(d='(vec_id // 2)')} AS pub_date, CAST(embedding AS DOUBLE[]) AS embedding,
            label FROM embeddings""",
    ),
    "topics": (
        (),
        """SELECT CAST(label AS BIGINT) AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v
        FROM embeddings GROUP BY label""",
    ),
    "requests": (
        (),
        """SELECT event_id, strftime(d - CAST(event_id % 40 AS INTEGER), '%Y-%m-%d') AS start_date,
            CASE WHEN event_id % 17 = 0 THEN 'latest'
                 ELSE strftime(d + CAST(event_id % 50 AS INTEGER), '%Y-%m-%d') END AS end_date,
            strftime(d - 20 + CAST(event_id % 45 AS INTEGER), '%Y-%m-%d') AS time_asked
        FROM (SELECT event_id, CAST(ts AS DATE) AS d FROM events)""",
    ),
    "answers": (
        (),
        r"""SELECT event_id AS question_id, value AS gt_mean, CAST(event_id % 3 AS DOUBLE) AS gt_std,
            repeat('<tool_call>{' || chr(10) || '}</tool_call>', event_id % 23)
            || '<think>\boxed{1} \pm \boxed{1}</think>'
            || CASE WHEN event_id % 5 = 0 THEN 'no number'
               ELSE '\boxed{' || (event_id % 100) || '} \pm \boxed{' || (event_id % 7) || '}' END AS response
        FROM events""",
    ),
}


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named views and all they read, as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in VIEWS[name][0]:
            visit(needed)
        order.append(name)

    for name in names.split():
        visit(name)
    # Statements are read several times in most queries, and are made from all lines.
    kept = {n: " MATERIALIZED" if n in ("statement", "bars", "prices") else "" for n in order}
    parts = [f"{n} AS{kept[n]} ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
