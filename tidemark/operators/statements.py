"""Company statements in long form: range reads, clean-up, mapping, industry figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import periods
from tidemark.operators import guards
from tidemark.operators.ratios import account_frame, column_for

# Segment name -> prefix of its note accounts.
NOTE_PREFIX = {"bank": "Bank_", "securities": "Sec_", "corp": "Corp_"}

# Statement -> caption prefix.
CAPTION_PREFIX = {
    "BS": "(Balance sheet) ",
    "IS": "(Income statement) ",
    "CF": "(Cash flow) ",
    "notes": "(Explaination) ",
}

# Derived account -> (added accounts, subtracted accounts), by segment.
DERIVED_ACCOUNTS = {
    "bank": {
        "BS_200": (("BS_160", "BS_180"), ("BS_131", "BS_139")),
        "BS_361": (
            (
                "BS_310",
                "BS_320",
                "BS_321",
                "BS_322",
                "BS_330",
                "BS_340",
                "BS_350",
                "BS_360",
            ),
            (),
        ),
    },
    "securities": {
        "IS_070": (("IS_040.1", "IS_050"), ("IS_060", "IS_061", "IS_062")),
        "IS_095": (("IS_060", "IS_061", "IS_062"), ("IS_050",)),
    },
    "corp": {
        "IS_027": (("IS_022", "IS_024", "IS_025", "IS_026"), ("IS_021",)),
    },
    "bank_notes": {
        "Bank_TM_65": (("Bank_TM_68", "Bank_TM_69", "Bank_TM_70"), ()),
    },
}

# Accounts without a trailing-twelve-month form.
NO_TTM_INCOME = (
    "IS_022", "IS_023", "IS_024", "IS_025", "IS_081", "IS_082", "IS_046", "IS_047", "IS_048",
    "IS_041", "IS_024", "IS_004", "IS_005", "IS_006", "IS_007", "IS_110", "IS_111", "IS_112",
    "IS_120", "IS_101", "IS_102",
)
NO_TTM_CASHFLOW = (
    "CF_002", "CF_009", "CF_010", "CF_011", "CF_021", "CF_080", "CF_081", "CF_057", "CF_058",
    "CF_120", "CF_021", "CF_022", "CF_023", "CF_024", "CF_025", "CF_026", "CF_027", "CF_028",
    "CF_029", "CF_030", "CF_031", "CF_032", "CF_033", "CF_200", "CF_201", "CF_202", "CF_203",
    "CF_204", "CF_205", "CF_206", "CF_207", "CF_210", "CF_211", "CF_212", "CF_213", "CF_034",
    "CF_035", "CF_036", "CF_037", "CF_038", "CF_039", "CF_040", "CF_041", "CF_042", "CF_043",
)


# -- range reads --------------------------------------------------------------


def year_and_quarter(date: str) -> tuple[int, int]:
    year, month = int(date[:4]), int(date[5:7])
    return year, (month + 2) // 3


def period_range(
    facts: DataFrame,
    entity: str,
    code_column: str,
    code: str,
    start: str,
    end: str,
    duration: str = "quarter",
    limit: str | None = None,
) -> DataFrame:
    """One account or ratio of one entity between two dates, by quarter or by year."""
    start, end = guards.limited_range(start, end, limit)
    (y0, q0), (y1, q1) = year_and_quarter(start), year_and_quarter(end)
    rows = facts.where((F.col("stock_code") == entity) & (F.col(code_column) == code))
    if duration == "year":
        rows = rows.where((F.col("quarter") == 0) & F.col("year").between(y0, y1))
    else:
        rows = rows.where(
            (F.col("quarter") != 0)
            & F.col("year").between(y0, y1)
            & ((F.col("year") > y0) | (F.col("quarter") >= q0))
            & ((F.col("year") < y1) | (F.col("quarter") <= q1))
        )
    return rows.select("year", "quarter", "data").orderBy("year", "quarter")


# -- clean-up ----------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key in the stated order."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("__row"))
    return kept.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def keep_last(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with the same key; null keys are equal.

    A key should occur once in a snapshot. If it may not, ``order`` names the columns whose
    largest value tells its last row.
    """
    names = old.columns
    if order:
        old, new = _last_per_key(old, keys, order), _last_per_key(new, keys, order)
    fresh = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(fresh, same, "left_anti").select(names).unionByName(new.select(names))


def _last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return kept.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def drop_empty(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def from_year(df: DataFrame, year: int = 2010) -> DataFrame:
    return df.where(F.col("year") >= year)


def labelled(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def shared_code(df: DataFrame) -> DataFrame:
    """Use the shared account code where one is given."""
    return df.withColumn("category_code", F.coalesce("share_code", "category_code"))


def statement_of(code: Column) -> Column:
    """``IS``, ``BS`` or ``CF`` from an account code."""
    return F.substring_index(code, "_", 1)


def without_annual_ttm(ratios: DataFrame) -> DataFrame:
    return ratios.where(~((F.col("quarter") == 0) & F.col("ratio_code").contains("TTM")))


def ttm_candidates(code: Column) -> Column:
    """Income and cash-flow accounts that have a trailing form."""
    chosen = F.startswith(code, F.lit("IS")) | F.startswith(code, F.lit("CF"))
    return chosen & ~code.isin([*NO_TTM_INCOME, *NO_TTM_CASHFLOW])


def with_ttm_codes(
    dimension: DataFrame, code_columns: Sequence[str], caption_columns: Sequence[str]
) -> DataFrame:
    """Append the trailing-twelve-month form of each eligible account; missing parts stay null."""
    code = F.col("category_code")
    flow = F.startswith(code, F.lit("IS_")) | F.startswith(code, F.lit("CF_"))
    extra = dimension.where(flow & ttm_candidates(code)).withColumns(
        {c: F.concat(F.col(c), F.lit("_TTM")) for c in ("category_code", *code_columns)}
        | {c: F.concat(F.col(c), F.lit(" (Trailing Twelve Months)")) for c in caption_columns}
    )
    return dimension.unionByName(extra)


def derived_account(
    facts: DataFrame, name: str, added: Sequence[str], subtracted: Sequence[str] = ()
) -> DataFrame:
    """Facts plus a new account computed per entity and period; null if a part is missing."""
    keys = [c for c in ("stock_code", "year", "quarter", "date_added", "segment") if c in facts.columns]
    frame = account_frame(facts, [*added, *subtracted], keys, how="avg")
    value = F.col(column_for(added[0]))
    for code in added[1:]:
        value = value + F.col(column_for(code))
    for code in subtracted:
        value = value - F.col(column_for(code))
    rows = frame.select(*keys, F.lit(name).alias("category_code"), value.alias("data"))
    return facts.unionByName(rows, allowMissingColumns=True)


def wide_to_long(sheet: DataFrame, ids: Sequence[str], skip: str = "VND") -> DataFrame:
    """Sheet with one column per period -> rows with ``time`` and ``data``."""
    periods_ = [c for c in sheet.columns if c not in ids and skip not in c]
    return sheet.unpivot(list(ids), periods_, "time", "data")


def with_period(df: DataFrame, label: str = "time") -> DataFrame:
    """Replace a period label by ``quarter``, ``year`` and the period's date."""
    parsed = periods.parse_period(F.col(label))
    return (
        df.withColumns({"quarter": parsed["quarter"], "year": parsed["year"]})
        .withColumn("date_added", periods.period_stamp(F.col("year"), F.col("quarter")))
        .drop(label)
    )


def aligned_captions(
    rows: DataFrame, file: str, position: str, caption: str, template: Sequence[tuple[str, str]]
) -> DataFrame:
    """Give each line of a sheet the code of the template entry it stands for.

    The template is walked once, top down: a line takes the next entry's code
    when its trimmed caption equals that entry's caption, otherwise it gets
    null. A file is one worksheet, so its captions fit in one row.
    """
    entries = F.array(
        *[F.struct(F.lit(code).alias("code"), F.lit(text.strip()).alias("text")) for code, text in template]
    )
    lines = F.array_sort(F.collect_list(F.struct(position, caption)))
    sheets = rows.groupBy(file).agg(lines.alias("lines")).withColumn("template", entries)
    # Only the places of hits are carried along: as many as the template has entries at most.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(state: Column, line: Column) -> Column:
        entry = F.get(F.col("template"), F.size(state["hits"]))
        hit = F.coalesce(tx.strip(line[caption]) == entry["text"], F.lit(False))
        hits = F.when(hit, F.concat(state["hits"], F.array(state["at"]))).otherwise(state["hits"])
        return F.struct((state["at"] + 1).alias("at"), hits.alias("hits"))

    sheets = sheets.withColumn("hits", F.aggregate("lines", start, step, lambda s: s["hits"]))

    def code(line: Column, at: Column) -> Column:
        place = F.array_position(F.col("hits"), at).cast("int")
        return F.when(place > 0, F.get(F.col("template"), place - 1)["code"])

    codes = F.transform("lines", code)
    return (
        sheets.select(file, F.explode(F.arrays_zip("lines", codes.alias("codes"))).alias("z"))
        .select(
            file,
            F.col("z.lines")[position].alias(position),
            F.col("z.lines")[caption].alias(caption),
            F.col("z.codes").alias("category_code"),
        )
    )


# -- mapping and assembly ---------------------------------------------------------


def to_universal(facts: DataFrame, mapping: DataFrame, own: str, keep_unmapped: bool = True) -> DataFrame:
    """Replace a segment's own account codes by the universal ones of ``mapping``."""
    pairs = mapping.select(F.col(own).alias("__own"), F.col("category_code").alias("__universal"))
    joined = facts.join(pairs, facts["category_code"] == F.col("__own"), "left")
    result = joined.drop("category_code", "__own").withColumnRenamed("__universal", "category_code")
    return result if keep_unmapped else result.dropna(subset=["category_code"])


def stacked(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a column missing from a part is null there."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def codes_missing(left: DataFrame, right: DataFrame, column: str = "category_code") -> DataFrame:
    """Distinct codes of ``left`` that ``right`` lacks."""
    codes = left.select(column).where(F.col(column).isNotNull()).distinct()
    return codes.join(right.select(column), column, "left_anti")


# -- industries ---------------------------------------------------------------------


def with_industry(facts: DataFrame, companies: DataFrame) -> DataFrame:
    return facts.join(companies.select("stock_code", "industry"), "stock_code", "left")


def industry_statements(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Sum and mean of each account per industry and period; facts without industry drop out."""
    return (
        with_industry(facts, companies)
        .where(F.col("industry").isNotNull())
        .groupBy("industry", "year", "quarter", "category_code", "date_added")
        .agg(F.sum("data").alias("data_sum"), F.avg("data").alias("data_mean"))
    )


def industry_mean_rows(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Industry means in the shape of statement facts, the industry in place of the entity."""
    return industry_statements(facts, companies).select(
        F.col("industry").alias("stock_code"),
        "category_code",
        F.col("data_mean").alias("data"),
        "year",
        "quarter",
        "date_added",
        F.lit("industry").alias("segment"),
    )


def largest_entities(
    facts: DataFrame, companies: DataFrame, metric: str = "BS_400", top: int = 20
) -> DataFrame:
    """The ``top`` entities by ``metric`` in each industry and period; ties go by code."""
    groups = ["industry", "year", "quarter"]
    ranked = Window.partitionBy(*groups).orderBy(F.col("data").desc_nulls_last(), "stock_code")
    return (
        with_industry(facts.where(F.col("category_code") == metric), companies)
        .where(F.col("industry").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
        .select(*groups, "stock_code", "rank")
    )


def industry_ratios(
    ratios: DataFrame,
    facts: DataFrame,
    companies: DataFrame,
    metric: str = "BS_400",
    top: int = 20,
) -> DataFrame:
    """Mean ratio of each industry's largest entities."""
    return member_means(ratios, largest_entities(facts, companies, metric, top).drop("rank"))


def member_means(ratios: DataFrame, members: DataFrame) -> DataFrame:
    """Mean ratio of ``members`` ``(industry, year, quarter, stock_code)`` per industry and period."""
    return (
        ratios.join(members, ["year", "quarter", "stock_code"])
        .groupBy("industry", "year", "quarter", "ratio_code")
        .agg(F.avg("data").alias("data_mean"))
        .withColumn("date_added", periods.period_stamp(F.col("year"), F.col("quarter")))
    )


def with_period_dates(ratios: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach the date of each entity's period; ratios of a period without facts drop out."""
    dates = (
        facts.where(F.col("date_added").isNotNull())
        .groupBy("stock_code", "year", "quarter")
        .agg(F.max("date_added").alias("date_added"))
    )
    return ratios.join(dates, ["stock_code", "year", "quarter"])
