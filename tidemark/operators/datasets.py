"""Question sets: questions from series, statements and ratios; splits; records; clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import measures, periods
from tidemark.functions import text as tx
from tidemark.operators.ordered import hash_bucket, hash_order, numbered

# Question templates and names (Vietnamese).
RETURN_QUESTION = "Tỷ suất sinh lời của {name} trong {period} năm {year} là bao nhiêu %?"
STATS_QUESTION = (
    "Giá trị trung bình và độ lệch chuẩn của {name} trong {period} năm {year} là bao nhiêu?"
)
STATEMENT_QUESTION = "{item} của {owner} trong quý {quarter} năm {year} là bao nhiêu tỷ VND?"
RATIO_QUESTION = "{item} của {owner} trong quý {quarter} năm {year} là bao nhiêu?"
MACRO_QUESTION = "Mức thay đổi của Tỷ lệ {item} trong quý {quarter} năm {year} là bao nhiêu %?"
QUARTER_WORD, MONTH_WORD = "quý", "tháng"
STOCK_WORD, INDEX_WORD = "cổ phiếu", "chỉ số"
COMPANY_WORD, BANK_WORD, INDUSTRY_WORD = "công ty", "ngân hàng", "ngành"
COMMODITY_NAMES = {
    "Gold": "Vàng",
    "Silver": "Bạc",
    "Brent Crude Oil": "Dầu Brent",
    "Crude Oil WTI": "Dầu WTI",
    "Natural Gas": "Khí tự nhiên",
    "Gasoline": "Xăng",
}
STATEMENT_ITEMS = {
    "IS_020": "Doanh thu",
    "IS_100": "Lợi nhuận ròng",
    "BS_125": "Dư nợ cho vay khách hàng",
    "BS_300": "Tổng nợ phải trả",
    "Bank_TM_121": "Tiền gửi không kỳ hạn",
    "Bank_TM_45": "Cho vay ngành xây dựng",
    "Bank_TM_61": "Cho vay bất động sản và tư vấn",
    "CF_130": "Tiền và các khoản tương đương tiền tại thời điểm cuối kỳ",
}
RATIO_ITEMS = {
    "NIM": "NIM",
    "BDR": "Tỷ lệ nợ xấu",
    "ROE": "Tỷ suất sinh lời trên vốn chủ sở hữu",
    "ROA": "Tỷ suất sinh lời trên tổng tài sản",
    "EBITDA": "EBITDA",
    "DTTCR": "Nợ trên tổng vốn chủ sở hữu",
    "QR": "Khả năng nhanh toán nhanh",
    "CashR": "Khả năng thanh toán nhanh bằng tiền mặt",
}
BANK_RATIO_ITEMS = {"NIM": "NIM", "BDR": "Tỷ lệ nợ xấu"}
INDUSTRY_NAMES = {
    "Basic Resources": "Tài nguyên Cơ bản",
    "Financial Services": "Dịch vụ Tài chính",
    "Utilities (Electricity, Water & Gas)": "Tiện ích (Điện, Nước & Khí đốt)",
    "Banking": "Ngân hàng",
    "Food and Beverages": "Thực phẩm và Đồ uống",
    "Retail": "Bán lẻ",
    "Travel and Leisure": "Du lịch và Giải trí",
    "Chemicals": "Hóa chất",
    "Information Technology": "Công nghệ Thông tin",
    "Oil and Gas": "Dầu khí",
    "Real Estate": "Bất động sản",
}
INFLATION_WORD, UNEMPLOYMENT_WORD = "lạm phát", "thất nghiệp"
# Tickers of the leading index.
PREFERRED_TICKERS = (
    "ACB", "BCM", "BID", "BVH", "CTG", "FPT", "GAS", "GVR", "HDB", "HPG", "MBB", "MSN", "MWG",
    "PLX", "POW", "SAB", "SHB", "SSB", "SSI", "STB", "TCB", "TPB", "VCB", "VHM", "VIB", "VIC",
    "VJC", "VNM", "VPB", "VRE",
)
NON_ENTITY_TYPES = ("macro", "commodity", "index")
MATH_INSTRUCTION = 'Let\'s think step by step and output the final answer after "####".'

QUESTION_COLUMNS = [
    "year",
    "time_val",
    "is_quarter",
    "question_raw",
    "answer_raw",
    "type",
    "time_asked",
    "gap",
    "std",
    "id",
]


def fill_template(template: str, **parts: Column) -> Column:
    """``{name}`` placeholders of a text replaced by columns."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), parts[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


def renamed(value: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """Look a value up in a map of names; unknown values stay (or take ``default``)."""
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, value), value if default is None else default)


def ask_gap(identity: Column, is_quarter: Column, seed: int | str = 0) -> Column:
    """Months between asking and the period's end, by weighted choice.

    Quarters: 3 (45 %), 2 (45 %), 1 (10 %). Months: 2 (50 %), 1 (50 %).
    """
    draw = F.conv(F.substring(hash_order(identity, seed), 1, 8), 16, 10).cast("bigint") % 100
    by_quarter = F.when(draw < 45, 3).when(draw < 90, 2).otherwise(1)
    return F.when(is_quarter, by_quarter).otherwise(F.when(draw < 50, 2).otherwise(1))


def with_ask_date(df: DataFrame, identity: Column, seed: int | str = 0) -> DataFrame:
    """Add ``gap`` and ``time_asked`` to rows with ``year``, ``time_val`` and ``is_quarter``."""
    month = F.when(F.col("is_quarter"), F.col("time_val") * 3).otherwise(F.col("time_val"))
    end = periods.month_end(F.col("year"), month.cast("int"))
    return df.withColumn("gap", ask_gap(identity, F.col("is_quarter"), seed)).withColumn(
        "time_asked", F.date_format(periods.ask_date(end, F.col("gap")), "yyyy-MM-dd")
    )


def market_questions(
    stats: DataFrame, key: str, prefix: str, name: Column, factor: float = 1, seed: int | str = 0
) -> DataFrame:
    """Two questions per series and period: the return, and the mean with its deviation."""
    is_quarter = F.col("period_type") == "quarter"
    word = F.when(is_quarter, F.lit(QUARTER_WORD)).otherwise(F.lit(MONTH_WORD))
    period = F.concat(word, F.lit(" "), F.col("time_val").cast("string"))
    identity = F.concat_ws(
        "/", F.lit(prefix), F.col(key), F.col("year"), F.col("period_type"), F.col("time_val")
    )
    rows = with_ask_date(
        stats.withColumns({"is_quarter": is_quarter, "period_id": identity, "period": period}),
        identity,
        seed,
    )
    base = {c: F.col(c) * F.lit(factor) for c in ("q_close", "start_close", "mean_close", "std_close")}
    change = measures.percent_change(base["q_close"], base["start_close"])
    risk = measures.volatility(F.col("std_daily_return"), F.col("duration"))
    spread = F.coalesce(F.round(base["std_close"], 2), F.lit(0.0))
    parts = {"name": name, "period": F.col("period"), "year": F.col("year")}

    def question(kind: str, template: str, answer: Column, std: Column) -> Column:
        return F.struct(
            F.lit(f"{prefix}_{kind}").alias("type"),
            fill_template(template, **parts).alias("question_raw"),
            answer.cast("string").alias("answer_raw"),
            F.round(std, 4).alias("std"),
        )

    both = F.array(
        question("return", RETURN_QUESTION, F.round(change, 2), risk),
        question("stats", STATS_QUESTION, F.coalesce(F.round(base["mean_close"], 2), F.lit(0.0)), spread),
    )
    return rows.select("*", F.inline(both)).select(
        key,
        *[c for c in QUESTION_COLUMNS if c != "id"],
        F.md5(F.concat_ws("/", "period_id", "type")).alias("id"),
    )


def _owner(segment: Column, code: Column, with_industry: bool) -> Column:
    plain = F.when(segment == "bank", F.concat(F.lit(BANK_WORD + " "), code)).otherwise(
        F.concat(F.lit(COMPANY_WORD + " "), code)
    )
    if not with_industry:
        return plain
    industry = F.concat(F.lit(INDUSTRY_WORD + " "), renamed(code, INDUSTRY_NAMES))
    return F.when(segment == "industry", industry).otherwise(plain)


def _period_questions(
    rows: DataFrame, kind: Column, template: str, parts: Mapping[str, Column], answer: Column, key: Sequence[str], seed
) -> DataFrame:
    """Questions about a quarter; rows without an answer are left out."""
    identity = F.concat_ws("/", kind, *[F.col(c) for c in key], F.col("year"), F.col("quarter"))
    asked = with_ask_date(
        rows.withColumns({"time_val": F.col("quarter"), "is_quarter": F.lit(True)}), identity, seed
    )
    return (
        asked.withColumns(
            {
                "type": kind,
                "question_raw": fill_template(
                    template, quarter=F.col("quarter"), year=F.col("year"), **parts
                ),
                "answer_raw": answer.cast("string"),
                "std": F.lit(None).cast("double"),
                "id": F.md5(identity),
            }
        )
        .where(F.col("answer_raw").isNotNull())
        .select(*key, *QUESTION_COLUMNS)
    )


def statement_questions(
    facts: DataFrame, items: Mapping[str, str] = STATEMENT_ITEMS, first_year: int = 2023, seed: int | str = 0
) -> DataFrame:
    """Questions about chosen accounts, by quarter."""
    rows = facts.where(
        F.col("category_code").isin(list(items))
        & (F.col("year") >= first_year)
        & (F.col("quarter") > 0)
    )
    parts = {
        "item": renamed(F.col("category_code"), items),
        "owner": _owner(F.lower("segment"), F.col("stock_code"), True),
    }
    kind = F.concat(F.lit("financial_"), "category_code")
    return _period_questions(
        rows, kind, STATEMENT_QUESTION, parts, F.col("data"), ["stock_code", "category_code"], seed
    )


def ratio_questions(
    ratios: DataFrame,
    items: Mapping[str, str] = RATIO_ITEMS,
    first_year: int = 2023,
    banks_only: bool = False,
    seed: int | str = 0,
) -> DataFrame:
    """Questions about chosen ratios, by quarter; industries are left out."""
    rows = ratios.where(
        F.col("ratio_code").isin(list(items))
        & (F.col("year") >= first_year)
        & (F.col("quarter") > 0)
        & (F.col("segment") != "industry")
    )
    owner = (
        F.concat(F.lit(BANK_WORD + " "), "stock_code")
        if banks_only
        else _owner(F.lower("segment"), F.col("stock_code"), False)
    )
    prefix = "bank_ratio_" if banks_only else "ratio_"
    return _period_questions(
        rows,
        F.concat(F.lit(prefix), "ratio_code"),
        RATIO_QUESTION,
        {"item": renamed(F.col("ratio_code"), items), "owner": owner},
        F.round("data", 4),
        ["stock_code", "ratio_code"],
        seed,
    )


def macro_questions(changes: DataFrame, key: Sequence[str] = ("indicator_name",), seed: int | str = 0) -> DataFrame:
    """Questions about the change of an indicator from quarter to quarter."""
    name = F.col("indicator_name")
    item = F.when(name.contains("Inflation"), F.lit(INFLATION_WORD)).otherwise(
        F.lit(UNEMPLOYMENT_WORD)
    )
    kind = F.concat(F.lit("macro_"), F.lower(F.substring_index(name, "_", 1)))
    return _period_questions(
        changes, kind, MACRO_QUESTION, {"item": item}, F.round("increase_pct", 2), list(key), seed
    )


def split_of(
    asked: Column,
    boundary: str = "2025-09-30",
    validation: Sequence[str] = ("2025-09-30", "2025-06-30"),
) -> Column:
    """Train before the boundary, test after it; validation dates belong to neither."""
    return (
        F.when(asked.isin(list(validation)), "val").when(asked < boundary, "train").otherwise("test")
    )


def overlapping_splits(
    questions: DataFrame,
    boundary: str = "2025-09-30",
    validation: Sequence[str] = ("2025-09-30", "2025-06-30"),
) -> DataFrame:
    """Like ``split_of`` but an early validation date is in the training set too."""
    asked = F.col("time_asked")
    splits = F.array_compact(
        F.array(
            F.when(asked < boundary, F.lit("train")),
            F.when(asked.isin(list(validation)), F.lit("val")),
            F.when(asked > boundary, F.lit("test")),
        )
    )
    return questions.withColumn("split", F.explode(splits))


def with_running_index(
    df: DataFrame, split: str = "split", identity: str = "id", seed: int | str = 0
) -> DataFrame:
    """Number the rows of each split from 0 in shuffled order."""
    digest = hash_order(F.col(identity), seed)
    return numbered(df, [split], [digest], hash_bucket(digest), "index", start=0)


def as_records(questions: DataFrame, source: str = "questions", ability: str = "math") -> DataFrame:
    """Nested question records; rows whose answer is not a number are dropped."""
    mean = measures.to_float(F.col("answer_raw"))
    return (
        questions.withColumn("__mean", mean)
        .where(F.col("__mean").isNotNull())
        .select(
            F.lit(source).alias("data_source"),
            F.array(
                F.struct(F.lit("user").alias("role"), F.col("question_raw").alias("content"))
            ).alias("prompt"),
            F.lit(ability).alias("ability"),
            F.struct(
                F.lit("rule").alias("style"),
                F.struct(
                    F.col("__mean").alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std")
                ).alias("ground_truth"),
            ).alias("reward_model"),
            F.struct(
                "split",
                F.col("index").cast("bigint").alias("index"),
                "time_asked",
                F.col("gap").cast("bigint").alias("gap"),
                F.col("type").alias("question_type"),
                "std",
                "id",
            ).alias("extra_info"),
        )
    )


def entity_marks(prompt: Column, question_type: Column, preferred: Sequence[str] = PREFERRED_TICKERS) -> dict[str, Column]:
    """Whether a question is about one company, and whether that is a preferred one."""
    ticker = tx.entity_ticker(prompt)
    general = F.lit(False)
    for prefix in NON_ENTITY_TYPES:
        general = general | F.startswith(F.coalesce(question_type, F.lit("")), F.lit(prefix))
    return {"is_entity": ~general & ticker.isNotNull(), "is_preferred": ticker.isin(list(preferred))}


# -- normalising foreign records --------------------------------------------------

_LOOSE = "data_source string, prompt string, ability string, reward_model string, extra_info string"


def _object(text: Column, ddl: str) -> Column:
    """Parse a JSON object held as text; anything else gives null."""
    return F.when(F.startswith(F.trim(text), F.lit("{")), F.from_json(text, ddl))


def normalised_records(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON lines of any shape -> records of the fixed question schema.

    Lines that are not JSON objects are left out; missing parts become empty
    text, empty lists or nulls; a ground truth given as JSON text is parsed.
    """
    options = {"columnNameOfCorruptRecord": "__bad"}
    raw = F.when(
        F.startswith(F.trim(F.col(text)), F.lit("{")),
        F.from_json(F.col(text), _LOOSE + ", __bad string", options),
    )
    rows = lines.withColumn("r", raw).where(F.col("r").isNotNull() & F.col("r.__bad").isNull())
    messages = F.coalesce(
        F.when(
            F.startswith(F.trim("r.prompt"), F.lit("[")), F.from_json("r.prompt", "array<string>")
        ),
        F.array().cast("array<string>"),
    )
    objects = F.filter(messages, lambda m: F.startswith(F.trim(m), F.lit("{")))
    prompt = F.transform(
        F.transform(objects, lambda m: F.from_json(m, "role string, content string")),
        lambda m: F.struct(
            measures.text_or_empty(m["role"]).alias("role"),
            measures.text_or_empty(m["content"]).alias("content"),
        ),
    )
    rows = rows.withColumn("rm", _object(F.col("r.reward_model"), "style string, ground_truth string"))
    rows = rows.withColumn("gt", _object(F.col("rm.ground_truth"), "mean string, std string")).withColumn(
        "ex",
        _object(
            F.col("r.extra_info"),
            "split string, index string, time_asked string, gap string, question_type string, "
            "std string, id string",
        ),
    )
    return rows.select(
        measures.text_or_empty(F.col("r.data_source")).alias("data_source"),
        prompt.alias("prompt"),
        measures.text_or_empty(F.col("r.ability")).alias("ability"),
        F.struct(
            measures.text_or_empty(F.col("rm.style")).alias("style"),
            F.struct(
                measures.to_float(F.col("gt.mean")).alias("mean"),
                measures.to_float(F.col("gt.std")).alias("std"),
            ).alias("ground_truth"),
        ).alias("reward_model"),
        F.struct(
            measures.text_or_empty(F.col("ex.split")).alias("split"),
            measures.to_int(F.col("ex.index")).alias("index"),
            measures.text_or_empty(F.col("ex.time_asked")).alias("time_asked"),
            measures.to_int(F.col("ex.gap")).alias("gap"),
            measures.text_or_empty(F.col("ex.question_type")).alias("question_type"),
            measures.to_float(F.col("ex.std")).alias("std"),
            measures.text_or_empty(F.col("ex.id")).alias("id"),
        ).alias("extra_info"),
    )


def math_records(
    problems: DataFrame, split: Column, order: str, source: str = "math", bucket_rows: int = 4096
) -> DataFrame:
    """Problems ``(question, answer)`` -> records with the extracted solution and a running index."""
    rows = problems.withColumn("split", split)
    indexed = numbered(
        rows, ["split"], [F.col(order)], F.floor(F.col(order) / bucket_rows), "index", start=0
    )
    question = F.concat(F.col("question"), F.lit(" " + MATH_INSTRUCTION))
    return indexed.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(
            F.lit("rule").alias("style"), tx.marked_answer(F.col("answer")).alias("ground_truth")
        ).alias("reward_model"),
        F.struct("split", "index", "answer", "question").alias("extra_info"),
    )


def with_system_prompt(
    records: DataFrame, template: str, ability: str = "finance", mark: str = "{current_time}"
) -> DataFrame:
    """Put a system message in front of prompts that lack one; the ask time fills the template."""
    before, found, after = template.partition(mark)
    content = (
        F.concat(F.lit(before), F.col("extra_info.time_asked"), F.lit(after))
        if found
        else F.lit(template)
    )
    system = F.struct(F.lit("system").alias("role"), content.alias("content"))
    first = F.get("prompt", F.lit(0))["role"]
    return records.withColumn(
        "prompt",
        F.when(F.coalesce(first != "system", F.lit(True)), F.concat(F.array(system), "prompt")).otherwise(
            F.col("prompt")
        ),
    ).withColumn("ability", F.lit(ability))

