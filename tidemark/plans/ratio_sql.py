"""Comparison SQL for the ratio families, one SELECT per ratio over a wide table."""

from __future__ import annotations

from tidemark.operators import ratio_bindings as rb
from tidemark.plans.derived_views import SEGMENTS

# SQL of the ratios that are not the first input over the second.
SHAPES = {
    "EBIT": "{0} + {1}",
    "EBITDA": "{0} + {1}",
    "free_cash_flow": "{0} - {1} - {2}",
    "quick_ratio": "({0} - {1}) / nullif({2}, 0)",
    "debt_to_tangible_net_worth_ratio": "{0} / nullif({1} - {2}, 0)",
    "cash_interest_coverage": "({0} + {1}) / nullif({1}, 0)",
    "earning_per_share": "{0}",
    "book_value_per_share": "CASE WHEN {0} = 0 THEN 0 ELSE {2} / nullif({1} / nullif({0}, 0), 0) END",
    "price_to_book_ratio": "{0} / nullif(CASE WHEN {1} = 0 THEN 0 ELSE {3} / nullif({2} / nullif({1}, 0), 0) END, 0)",
    "days_sales_outstanding": "CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END",
    "days_inventory_outstanding": "CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END",
    "days_payable_outstanding": "CASE WHEN {2} = 0 THEN 0 ELSE ({0} + {1}) / {2} END",
    "cash_conversion_cycle": (
        "CASE WHEN {5} = 0 THEN 0 ELSE {0} / {5} END + CASE WHEN {4} = 0 THEN 0 ELSE {3} / {4} END"
        " - CASE WHEN {4} = 0 THEN 0 ELSE ({1} + {2}) / {4} END"
    ),
    "current_account_saving_account_ratio": "({1} + {2}) / nullif({0}, 0)",
    "bad_debt_ratio": "{1} / nullif({0}, 0)",
    "non_performing_loan_coverage_ratio": "-{0} / nullif({1}, 0)",
}
# The same ratios when bound to three inputs.
THREE_INPUTS = {
    "profitability_of_operating_expenses": "({0} - {2}) / nullif({1}, 0)",
    "operating_profit_margin": "({0} - {1}) / nullif({2}, 0)",
}
PLAIN = "{0} / nullif({1}, 0)"


def wide(segment: str, source: str) -> str:
    codes = rb.account_codes(rb.BINDINGS[segment])
    columns = ", ".join(f"sum(data) FILTER (category_code = '{c}') AS \"{c}\"" for c in codes)
    return f"SELECT stock_code, year, quarter, {columns} FROM {source} GROUP BY ALL"


def account(code: str, alias: str = "p") -> str:
    return f'{alias}."{code}"'


def operand(entry, alias: str = "p") -> str:
    if isinstance(entry, tuple):
        return "(" + " + ".join(account(c, alias) for c in entry) + ")"
    return account(entry, alias)


def shape(name: str, inputs) -> str:
    if len(inputs) == 3 and name in THREE_INPUTS:
        return THREE_INPUTS[name]
    return SHAPES.get(name, PLAIN)


def needs(inputs) -> str:
    """Condition that each single trailing account occurs at all."""
    codes = [i for i in inputs if isinstance(i, str) and i.endswith("_TTM")]
    return " AND ".join(f"EXISTS (SELECT 1 FROM p WHERE \"{c}\" IS NOT NULL)" for c in codes) or "true"


def row(family: str, name: str, value: str, rest: str) -> str:
    return (
        f"SELECT p.stock_code, p.year, p.quarter, '{family}' AS family, '{name}' AS function_name,"
        f" CAST({value} AS DOUBLE) AS data FROM {rest}"
    )


PRIOR = "p JOIN p q ON q.stock_code = p.stock_code AND q.year = p.year - 1 AND q.quarter = 0"


def family_rows(segment: str, family: str) -> list[str]:
    bindings = rb.BINDINGS[segment]
    if family in ("yoy", "qoq"):
        return growth_rows(segment, family)
    averaged = {
        "profitability": rb.AVERAGED_PROFITABILITY[segment],
        "cashflow": rb.AVERAGED_CASHFLOW[segment],
    }.get(family, ())
    result = []
    for name, inputs in bindings.get(family, {}).items():
        if None in inputs or "free_cash_flow" in inputs:
            continue
        if family == "average_ttm":
            balance = inputs[1]
            source = f"""(SELECT *, CASE WHEN count("{balance}") OVER w = 4 AND year * 4 + quarter
                  - lag(year * 4 + quarter, 3) OVER (PARTITION BY stock_code ORDER BY year, quarter) = 3
                THEN (first_value("{balance}") OVER w + "{balance}") / 2 END AS mean
                FROM p WHERE quarter <> 0 WINDOW w AS (PARTITION BY stock_code ORDER BY year, quarter
                  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) p
                WHERE mean IS DISTINCT FROM 0 AND {needs(inputs)}"""
            result.append(row(family, name, f"{account(inputs[0])} / nullif(p.mean, 0)", source))
        elif family == "turnover":
            codes = inputs[1]
            total = " + ".join(f'coalesce("{c}", 0)' for c in codes)
            known = " OR ".join(f'"{c}" IS NOT NULL' for c in codes)
            sign = "-" if name == "cost_of_fund" else ""
            source = f"""(SELECT *, (b + coalesce(lag(b) OVER (PARTITION BY stock_code, quarter = 0
                  ORDER BY year, quarter), 0)) / 2 AS mean
                FROM (SELECT *, {total} AS b FROM p WHERE {known})) p WHERE "{inputs[0]}" IS NOT NULL"""
            result.append(
                row(family, name, f"{sign}({account(inputs[0])} / nullif(p.mean, 0))", source)
            )
        else:
            chosen = inputs[1:] if family == "average" else averaged
            prior = any(i in chosen for i in inputs)
            values = [
                f"(({operand(i)} + {operand(i, 'q')}) / 2)" if i in chosen else operand(i)
                for i in inputs
            ]
            source = PRIOR if prior else "p"
            result.append(
                row(family, name, shape(name, inputs).format(*values), f"{source} WHERE {needs(inputs)}")
            )
    return result


def growth_rows(segment: str, family: str) -> list[str]:
    bindings = rb.BINDINGS[segment]
    yearly = family == "yoy"
    codes = rb.account_codes({"growth": bindings["growth"]})
    if yearly:
        rows = "p"
        prior = "g LEFT JOIN g q ON q.stock_code = g.stock_code AND q.year = g.year - 1 AND q.quarter = g.quarter"
        shown = "true"
    else:
        rows = "p WHERE quarter <> 0"
        prior = (
            "g LEFT JOIN g q ON q.stock_code = g.stock_code"
            " AND q.year * 4 + q.quarter = g.year * 4 + g.quarter - 1"
        )
        shown = " OR ".join(f'g."{c}" IS NOT NULL' for c in codes)
    result = []
    for base, entry in bindings["growth"].items():
        if not yearly and base in rb.YEARLY_ONLY:
            continue
        if entry in ("EBIT", "EBITDA"):
            inputs = bindings["structure" if entry == "EBIT" else "cashflow"][entry]
            x = SHAPES[entry].format(*(operand(i) for i in inputs))
        elif isinstance(entry, tuple):
            x = " + ".join(
                f'CASE WHEN count({account(c)}) OVER (PARTITION BY p.stock_code) > 0 THEN {account(c)} ELSE 0 END'
                for c in entry
            )
        else:
            x = account(entry)
        source = f"(WITH g AS (SELECT p.*, {x} AS x FROM {rows}) SELECT g.*, q.x AS before FROM {prior} WHERE {shown}) p"
        name = rb.growth_name(base, "YoY" if yearly else "QoQ")
        result.append(row(family, name, "(p.x - p.before) / nullif(p.before, 0)", source))
    return result


def families_sql(families, segments=SEGMENTS) -> str:
    """Ratios of the families for the segments; reads ``facts_corp``, ``facts_bank``, …"""
    parts = []
    for segment in segments:
        rows = [r for f in families for r in family_rows(segment, f)]
        if rows:
            body = " UNION ALL ".join(rows)
            parts.append(
                f"SELECT * FROM (WITH p AS MATERIALIZED ({wide(segment, 'facts_' + segment)}) {body})"
            )
    return " UNION ALL ".join(parts)


def facts_views(trailing: str, price: bool) -> dict[str, str]:
    """Facts per segment: statements, trailing rows and, if wanted, prices."""
    views = {"ttm": trailing}
    for s in SEGMENTS:
        sql = f"""SELECT stock_code, category_code, year, quarter, data FROM statement WHERE segment = '{s}'
            UNION ALL SELECT stock_code, category_code, year, quarter, data FROM ttm WHERE segment = '{s}'"""
        if price:
            sql += f"""
            UNION ALL SELECT stock_code, 'Price', year, quarter, close FROM prices
            WHERE stock_code IN (SELECT stock_code FROM statement WHERE segment = '{s}')"""
        views["facts_" + s] = sql
    return views


def names_values() -> str:
    rows = ", ".join(f"('{f}', '{c}')" for f, (c, _) in rb.ratio_names().items())
    return f"SELECT * FROM (VALUES {rows}) AS v(function_name, ratio_code)"


