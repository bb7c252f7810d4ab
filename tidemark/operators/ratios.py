"""Financial ratios from long statement facts.

The facts of a segment are laid out once per (entity, period). Neighbouring
periods are then read with windows that all sort by entity, the ratios are SQL
expressions over the resulting row, and one ``inline`` turns them back into
long rows: one scan, one aggregation and one exchange by entity for any number
of families. A window holds one entity's periods, five rows a year.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ratio_bindings as rb

KEYS = ("stock_code", "year", "quarter")

# Families produced unless asked otherwise; "days" is available on request.
DEFAULT_FAMILIES = (
    "structure",
    "liquidity",
    "risk",
    "income",
    "profitability",
    "cashflow",
    "average",
    "price",
    "yoy",
    "turnover",
    "average_ttm",
    "qoq",
    "notes",
)


def column_for(code: str) -> str:
    return "a_" + code.replace(".", "_")


def _account_sums(codes: Iterable[str], function: str = "sum") -> list:
    return [
        F.expr(f"{function}(CASE WHEN category_code = '{c}' THEN data END)").alias(column_for(c))
        for c in codes
    ]


def account_frame(
    facts: DataFrame, codes: Sequence[str], keys: Sequence[str] = KEYS, how: str = "sum"
) -> DataFrame:
    """One row per key with a column per account (null where the account is absent)."""
    rows = facts.where(F.col("category_code").isin(list(codes)))
    return rows.groupBy(*keys).agg(*_account_sums(codes, how))


def codes_present(facts: DataFrame, codes: Iterable[str]) -> set[str]:
    """Which of ``codes`` occur in the facts. The result is bounded by ``codes``."""
    rows = facts.where(F.col("category_code").isin(list(codes))).select("category_code").distinct()
    return {r[0] for r in rows.collect()}


# -- formulas -------------------------------------------------------------------


def over(numerator: str, denominator: str) -> str:
    """Guarded division: null when the denominator is 0."""
    return f"try_divide({numerator}, {denominator})"


def _book_per_share(eps: str, income: str, equity: str) -> str:
    return f"CASE WHEN {eps} = 0 THEN 0D ELSE {over(equity, over(income, eps))} END"


def _turns(amount: str, flow: str) -> str:
    return f"CASE WHEN {flow} = 0 THEN 0D ELSE {over(amount, flow)} END"


_FORMULAS = {
    "EBIT": lambda pretax, interest=None: pretax if interest is None else f"({pretax} + {interest})",
    "EBITDA": lambda ebit, depreciation: f"({ebit} + {depreciation})",
    "free_cash_flow": lambda operating, capital, paid: f"({operating} - {capital} - {paid})",
    "quick_ratio": lambda assets, stock, debt: over(f"({assets} - {stock})", debt),
    "debt_to_tangible_net_worth_ratio": lambda debt, equity, intangible: over(
        debt, f"({equity} - {intangible})"
    ),
    "profitability_of_operating_expenses": lambda income, costs, less=None: over(
        income if less is None else f"({income} - {less})", costs
    ),
    "operating_profit_margin": lambda income, b, c=None: (
        over(income, b) if c is None else over(f"({income} - {b})", c)
    ),
    "cash_interest_coverage": lambda cash, interest: over(f"({cash} + {interest})", interest),
    "earning_per_share": lambda eps: eps,
    "book_value_per_share": _book_per_share,
    "price_to_book_ratio": lambda price, *book: over(price, _book_per_share(*book)),
    "days_sales_outstanding": _turns,
    "days_inventory_outstanding": _turns,
    "days_payable_outstanding": lambda short, long, cost: _turns(f"({short} + {long})", cost),
    "cash_conversion_cycle": lambda due, short, long, stock, cost, sales: (
        f"({_turns(due, sales)} + {_turns(stock, cost)} - {_turns(f'({short} + {long})', cost)})"
    ),
    "current_account_saving_account_ratio": lambda total, demand, margin: over(
        f"({demand} + {margin})", total
    ),
    "bad_debt_ratio": lambda total, bad: over(bad, total),
    "non_performing_loan_coverage_ratio": lambda allowance, bad: over(f"(-{allowance})", bad),
}


def formula(name: str):
    """Expression builder of a ratio; most are the first input over the second."""
    return _FORMULAS.get(name, over)


# -- expressions over the account frame -------------------------------------------

_ENTITY = "PARTITION BY stock_code"
_LAST_YEAR = f"({_ENTITY} ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
_SAME_PERIOD = f"({_ENTITY}, quarter ORDER BY year)"
_RUN = f"{_ENTITY}, annual ORDER BY year, quarter"


@dataclass(frozen=True)
class _Ratio:
    family: str
    name: str
    value: str
    shown: str | None = None


class _Segment:
    """One segment's bindings as expressions; ``present`` are its account codes.

    Intermediate columns are collected in three layers: ``base`` reads the
    account frame, ``near`` reads neighbouring rows of ``base``, and the ratios
    read both.
    """

    def __init__(self, bindings: dict, present: set[str], averaged: dict, derived_inputs: bool, calendar: bool):
        self.bindings = bindings
        self.present = present
        self.averaged = averaged
        self.derived_inputs = derived_inputs
        self.calendar = calendar
        self.base: dict[str, str] = {}
        self.near: dict[str, str] = {}

    def total(self, codes: Iterable[str]) -> str:
        """Sum over the codes the segment has; null if one of them is null."""
        terms = [column_for(c) for c in codes if c in self.present]
        return f"({' + '.join(terms)})" if terms else "0D"

    def operand(self, entry) -> str | None:
        """Expression of one input, or None when a single account is absent from the segment."""
        if isinstance(entry, tuple):
            return self.total(entry)
        return column_for(entry) if entry in self.present else None

    def _name(self, layer: dict[str, str], prefix: str, expression: str) -> str:
        for name, known in layer.items():
            if known == expression:
                return name
        name = f"{prefix}{len(layer)}"
        layer[name] = expression
        return name

    def prior_annual(self, value: str) -> str:
        """The annual figure of the year before."""
        return self._name(self.near, "n", f"max(CASE WHEN annual THEN {value} END) OVER {_LAST_YEAR}")

    def ratio(self, family: str, name: str) -> _Ratio | None:
        build = getattr(self, f"_{family}", None) or self._plain
        return build(family, name, self.bindings[family][name])

    def _plain(self, family: str, name: str, inputs) -> _Ratio | None:
        values = [self.operand(i) for i in inputs]
        if name == "EBIT" and values[0] is not None and values[1] is None:
            values = values[:1]
        if any(v is None for v in values):
            return None
        return _Ratio(family, name, formula(name)(*values))

    def _with_prior_annual(self, family: str, name: str, inputs, chosen) -> _Ratio | None:
        """Inputs listed in ``chosen`` are averaged; no row without a prior annual figure."""
        values, shown = [], None
        for entry in inputs:
            if self.derived_inputs and entry == "free_cash_flow":
                flow = self.ratio(family, "free_cash_flow")
                value = flow.value if flow else None
            else:
                value = None if entry is None else self.operand(entry)
            if value is None:
                return None
            if entry in chosen:
                value = f"(({value} + {self.prior_annual(value)}) / 2)"
                shown = f"{self.prior_annual('1')} IS NOT NULL"
            values.append(value)
        return _Ratio(family, name, formula(name)(*values), shown)

    def _profitability(self, family, name, inputs):
        return self._with_prior_annual(family, name, inputs, self.averaged["profitability"])

    def _cashflow(self, family, name, inputs):
        return self._with_prior_annual(family, name, inputs, self.averaged["cashflow"])

    def _average(self, family, name, inputs):
        return self._with_prior_annual(family, name, inputs, inputs[1:])

    def _average_ttm(self, family, name, inputs):
        income, balance = (self.operand(i) for i in inputs)
        if income is None or balance is None:
            return None
        whole = f"count({balance}) OVER ({_RUN} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4"
        if self.calendar:
            whole += f" AND idx - lag(idx, 3) OVER ({_RUN}) = 3"
        first = f"lag({balance}, 3) OVER ({_RUN})"
        mean = self._name(self.near, "n", f"CASE WHEN {whole} THEN ({first} + {balance}) / 2 END")
        shown = f"NOT annual AND NOT coalesce({mean} = 0, false)"
        return _Ratio(family, name, over(income, mean), shown)

    def _turnover(self, family, name, inputs):
        flow = self.operand(inputs[0])
        balances = [column_for(c) for c in inputs[1] if c in self.present]
        if flow is None or not balances:
            return None
        known = f"coalesce({', '.join(balances)}) IS NOT NULL"
        added = " + ".join(f"coalesce({b}, 0D)" for b in balances)
        balance = self._name(self.base, "b", f"CASE WHEN {known} THEN {added} END")
        earlier = self._name(
            self.near,
            "n",
            f"last({balance}, true) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        )
        value = over(flow, f"(({balance} + coalesce({earlier}, 0D)) / 2)")
        if name == "cost_of_fund":
            value = f"(-{value})"
        return _Ratio(family, name, value, f"{balance} IS NOT NULL AND {flow} IS NOT NULL")

    def _growth_base(self, entry, rows: str) -> str | None:
        if entry in ("EBIT", "EBITDA"):
            family = "structure" if entry == "EBIT" else "cashflow"
            found = self.ratio(family, entry) if entry in self.bindings[family] else None
            return found.value if found else None
        if isinstance(entry, tuple):
            # An account the entity never reports counts as 0, a gap stays a gap.
            terms = []
            for c in (column_for(c) for c in entry if c in self.present):
                reported = f"count(CASE WHEN {rows} THEN {c} END) OVER ({_ENTITY}) > 0"
                terms.append(f"CASE WHEN {reported} THEN {c} ELSE 0D END")
            return " + ".join(terms) if terms else "0D"
        return self.operand(entry)

    def growth(self, suffix: str) -> list[_Ratio]:
        """Change against the same period last year (YoY) or the quarter before (QoQ)."""
        yearly = suffix == "YoY"
        bindings = self.bindings.get("growth", {})
        if yearly:
            window = _SAME_PERIOD
            near = f"lag(year) OVER {window} = year - 1"
            rows, shown = "true", None
        else:
            window = f"({_RUN})"
            near = f"NOT annual AND lag(idx) OVER {window} = idx - 1"
            rows = "NOT annual"
            codes = rb.account_codes({"growth": bindings})
            known = [column_for(c) for c in codes if c in self.present]
            shown = f"NOT annual AND coalesce({', '.join(known)}) IS NOT NULL" if known else "false"
        is_near = self._name(self.near, "n", near)
        result = []
        for base, entry in bindings.items():
            if not yearly and base in rb.YEARLY_ONLY:
                continue
            name, expression = rb.growth_name(base, suffix), self._growth_base(entry, rows)
            if expression is None:
                value = "CAST(NULL AS DOUBLE)"
            else:
                current = self._name(self.base, "b", expression)
                before = self._name(self.near, "n", f"lag({current}) OVER {window}")
                previous = f"CASE WHEN {is_near} THEN {before} END"
                value = over(f"({current} - {before})", previous)
            result.append(_Ratio(suffix.lower(), name, value, shown))
        return result

    def every(self, families: Sequence[str]) -> list[_Ratio]:
        found: list[_Ratio] = []
        for family in families:
            if family in ("yoy", "qoq"):
                found += self.growth("YoY" if family == "yoy" else "QoQ")
                continue
            names = self.bindings.get(family, {})
            found += [r for r in (self.ratio(family, n) for n in names) if r is not None]
        return found


def financial_ratios(
    facts: DataFrame,
    segment: str,
    families: Sequence[str] = DEFAULT_FAMILIES,
    codes: Iterable[str] | None = None,
    bindings: dict | None = None,
    averaging: str = "reference",
    derived_inputs: bool = False,
    calendar: bool = True,
    period_columns: Sequence[str] = (),
) -> DataFrame:
    """Long ratios ``(stock_code, year, quarter, family, function_name, data)`` of one segment.

    ``codes`` names the account codes the segment reports; when omitted they
    are looked up in the facts. Undefined ratios are null. ``averaging="all"``
    averages corporate balances too; ``derived_inputs`` lets a ratio use
    another ratio; ``calendar=False`` lets four-row averages ignore gaps.
    The largest value per period of each of ``period_columns`` is carried along.
    """
    bindings = rb.BINDINGS[segment] if bindings is None else bindings
    used = [f for f in bindings if f in families or (f == "growth" and {"yoy", "qoq"} & set(families))]
    if "growth" in used:
        used += ["structure", "cashflow"]
    wanted = rb.account_codes(bindings, used)
    present = set(codes) & set(wanted) if codes is not None else codes_present(facts, wanted)
    every = rb.AVERAGED_ALL[segment] if averaging == "all" else None
    averaged = {
        "profitability": every or rb.AVERAGED_PROFITABILITY[segment],
        "cashflow": every or rb.AVERAGED_CASHFLOW[segment],
    }
    layout = _Segment(bindings, present, averaged, derived_inputs, calendar)
    plan = layout.every(families)
    # Periods stay even if none of the wanted accounts is reported there.
    frame = facts.groupBy(*KEYS).agg(
        *_account_sums(c for c in wanted if c in present),
        *[F.max(c).alias(c) for c in period_columns],
        F.lit(1).alias("period"),
    )
    frame = frame.selectExpr("*", "quarter = 0 AS annual", "year * 4 + quarter - 1 AS idx")
    for layer in (layout.base, layout.near):
        if layer:
            frame = frame.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
    return _long(frame, plan, [*KEYS, *period_columns])


def _long(frame: DataFrame, plan: list[_Ratio], kept: list[str]) -> DataFrame:
    if not plan:
        empty = ["'' AS family", "'' AS function_name", "0D AS data"]
        return frame.selectExpr(*kept, *empty).where("false")
    entries, seen = [], {}
    for i, r in enumerate(plan):
        shown = r.shown
        for j in seen.get(r.name, ()):
            # A name bound twice gives a second row only where its value differs.
            differs = f"NOT (v{i} <=> v{j})"
            shown = differs if shown is None else f"{shown} AND {differs}"
        seen.setdefault(r.name, []).append(i)
        entry = f"named_struct('family', '{r.family}', 'function_name', '{r.name}', 'data', v{i})"
        entries.append(entry if shown is None else f"CASE WHEN {shown} THEN {entry} END")
    needed = sorted({c for c in frame.columns if any(c in (r.shown or "") for r in plan)})
    values = frame.selectExpr(
        *dict.fromkeys(kept + needed),
        *[f"CAST({r.value} AS DOUBLE) AS v{i}" for i, r in enumerate(plan)],
    )
    return values.selectExpr(*kept, f"inline(array({', '.join(entries)}))").where(
        "function_name IS NOT NULL"
    )


def ratio_dimension(spark) -> DataFrame:
    """Ratio function, code and published name."""
    rows = [(f, code, name) for f, (code, name) in rb.ratio_names().items()]
    return spark.createDataFrame(rows, "function_name string, ratio_code string, ratio_name string")


def with_ratio_codes(ratios: DataFrame) -> DataFrame:
    """Attach code and name; a ratio without a code is an error at run time.

    The dimension has a row per ratio known here, so it is sent to the ratio rows, of which a
    period has a hundred; dealing those out by name would put all of a name in one task.
    """
    joined = ratios.join(F.broadcast(ratio_dimension(ratios.sparkSession)), "function_name", "left")
    missing = "CAST(raise_error(concat('no ratio code for ', function_name)) AS STRING)"
    return joined.withColumn("ratio_code", F.expr(f"coalesce(ratio_code, {missing})"))
