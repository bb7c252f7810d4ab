"""Question-set, sampling and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import measures, scoring
from tidemark.functions import text as tx
from tidemark.operators import datasets as ds
from tidemark.operators import evaluation, sampling, series
from tidemark.operators import statements as st
from tidemark.plans import catalog_ratios, catalog_series, ratio_sql, ratio_tables
from tidemark.plans.registry import query
from tidemark.plans.derived_views import SEGMENTS

KEY = "series_key"

# -- answers ----------------------------------------------------------------------


@query(
    "scl17",
    r"""SELECT o_orderkey, replace(regexp_extract(a, '#### (\-?[0-9\.\,]+)', 1), ',', '') AS solution FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'so #### -1,2' || (o_orderkey % 1000) || '.5 apples' ELSE '#### ' || o_orderkey END AS a
        FROM orders)""",
)
def scl17(t):
    """Number after the answer mark, separators removed."""
    key = F.col("o_orderkey")
    text = F.when(
        key % 4 == 0, F.concat(F.lit("so #### -1,2"), (key % 1000).cast("string"), F.lit(".5 apples"))
    ).otherwise(F.concat(F.lit("#### "), key.cast("string")))
    return t["orders"].select("o_orderkey", tx.marked_answer(text).alias("solution"))


@query(
    "scl18",
    """SELECT c_custkey, nullif(regexp_extract('của ' || ['công ty', 'cổ phiếu', 'ngân hàng', 'ngành'][c_custkey % 4 + 1] || ' C' || (c_custkey % 150) || ' trong',
        '(?:công ty|cổ phiếu|ngân hàng)\\s+([A-Z0-9]{3})\\b', 1), '') AS ticker FROM customer""".replace("\\\\", "\\"),
)
def scl18(t):
    """Ticker named in a question."""
    kinds = F.array(*[F.lit(w) for w in (ds.COMPANY_WORD, ds.STOCK_WORD, ds.BANK_WORD, ds.INDUSTRY_WORD)])
    text = F.concat(
        F.lit("của "),
        F.get(kinds, (F.col("c_custkey") % 4).cast("int")),
        F.lit(" C"),
        (F.col("c_custkey") % 150).cast("string"),
        F.lit(" trong"),
    )
    return t["customer"].select("c_custkey", tx.entity_ticker(text).alias("ticker"))


_BOX = r"\\boxed\{([^}]*)\}\s*\\pm\s*\\boxed\{([^}]*)\}"


@query(
    "scl19",
    f"""SELECT question_id, try_cast(nullif(regexp_extract(response, '{_BOX}', 1), '') AS DOUBLE) AS mean,
        try_cast(nullif(regexp_extract(response, '{_BOX}', 2), '') AS DOUBLE) AS std FROM answers""",
    "answers",
)
def scl19(t):
    """First boxed pair of a response."""
    pair = scoring.boxed_pair(F.col("response"))
    return t.answers.select("question_id", pair["mean"].alias("mean"), pair["std"].alias("std"))


@query(
    "scl20",
    """SELECT question_id, CAST(len(regexp_extract_all(response, '(?s)<tool_call>.*?</tool_call>')) AS INTEGER) AS calls FROM answers""",
    "answers",
)
def scl20(t):
    """Tool calls of a response."""
    return t.answers.select("question_id", scoring.tool_calls(F.col("response")).alias("calls"))


@query(
    "scl21",
    """SELECT question_id, list_last(string_split(list_last(string_split(response, '</tool_call>')), '</think>')) AS answer FROM answers""",
    "answers",
)
def scl21(t):
    """Text after the last tool call and thinking mark."""
    return t.answers.select("question_id", scoring.answer_part(F.col("response")).alias("answer"))


_PDF = "(1 / (pow(2, 7.5) * gamma(7.5))) * pow({x}, 6.5) * exp(-{x} / 2.0)"


@query(
    "scl22",
    f"SELECT l_orderkey, l_linenumber, l_quantity, round({_PDF.format(x='l_quantity')}, 10) AS density FROM lineitem",
)
def scl22(t):
    """Chi-square density with 15 degrees of freedom."""
    density = scoring.chi_square_density(F.col("l_quantity"))
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_quantity", F.round(density, 10).alias("density")
    )


_NLL = """ln(ts / ps) + (ps * ps + (m - gt_mean) * (m - gt_mean)) / (2 * ts * ts) - 0.5"""
_SCORED = f"""
    SELECT *, greatest(CASE WHEN gt_std <= 0 THEN abs(gt_mean) * 0.05 ELSE gt_std END, 1e-9) AS ts,
        greatest(CASE WHEN s <= 0 THEN abs(m) * 0.01 ELSE s END, 1e-9) AS ps FROM (
      SELECT question_id, gt_mean, gt_std, len(regexp_extract_all(response, '(?s)<tool_call>.*?</tool_call>')) AS calls,
        try_cast(nullif(regexp_extract(a, '{_BOX}', 1), '') AS DOUBLE) AS m,
        try_cast(nullif(regexp_extract(a, '{_BOX}', 2), '') AS DOUBLE) AS s
      FROM (SELECT *, list_last(string_split(list_last(string_split(response, '</tool_call>')), '</think>')) AS a FROM answers))"""


@query(
    "scl23",
    f"SELECT question_id, round({_NLL}, 8) AS nll FROM parsed",
    "answers",
    {"parsed": _SCORED},
)
def scl23(t):
    """Divergence of answer and truth."""
    pair = scoring.boxed_pair(scoring.answer_part(F.col("response")))
    rows = t.answers.select("*", pair["mean"].alias("m"), pair["std"].alias("s"))
    nll = scoring.gaussian_divergence(F.col("m"), F.col("s"), F.col("gt_mean"), F.col("gt_std"))
    return rows.select("question_id", F.round(nll, 8).alias("nll"))


@query(
    "evl1",
    f"""SELECT question_id, round(pdf, 9) AS tool_call_score,
        CASE WHEN m IS NULL OR s IS NULL THEN -1 ELSE round(greatest(1 - 0.1 * ({_NLL}), -1), 9) END AS nll_score,
        CASE WHEN m IS NULL OR s IS NULL THEN -1 ELSE round(pdf + greatest(1 - 0.1 * ({_NLL}), -1), 9) END AS total_score,
        CASE WHEN m IS NULL OR s IS NULL THEN 'Failed to extract numerical answer' END AS error
    FROM (SELECT *, {_PDF.format(x='calls')} AS pdf FROM parsed)""",
    "answers",
    {"parsed": _SCORED},
)
def evl1(t):
    """All answers scored."""
    rows = evaluation.scored(t.answers).select(
        "question_id", "tool_call_score", "nll_score", "total_score", "error"
    )
    return rows.withColumns(
        {
            "tool_call_score": F.round("tool_call_score", 9),
            "nll_score": F.round("nll_score", 9),
            "total_score": F.round("total_score", 9),
        }
    )


@query(
    "evl2",
    "SELECT question_id, gt_mean FROM answers WHERE question_id NOT IN (SELECT o_orderkey * 3 FROM orders)",
    "answers",
)
def evl2(t):
    """Questions left to score."""
    done = t["orders"].select((F.col("o_orderkey") * 3).alias("question_id"))
    return evaluation.pending(t.answers, done).select("question_id", "gt_mean")


@query(
    "scl24",
    """SELECT doc_id, CAST(doc_id % 3 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS raw,
        try_cast(CAST(doc_id % 3 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS BIGINT) AS as_int,
        try_cast(CAST(doc_id % 3 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '.5' END AS DOUBLE) AS as_float,
        coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '') AS as_text FROM documents""",
)
def scl24(t):
    """Casts that give null or empty text instead of failing."""
    even = F.col("doc_id") % 2 == 0
    digit = (F.col("doc_id") % 3).cast("string")
    raw = F.concat(digit, F.when(even, "x").otherwise(""))
    return t["documents"].select(
        "doc_id",
        raw.alias("raw"),
        measures.to_int(raw).alias("as_int"),
        measures.to_float(F.concat(digit, F.when(even, "x").otherwise(".5"))).alias("as_float"),
        measures.text_or_empty(F.when(even, F.col("source"))).alias("as_text"),
    )


@query(
    "scl25",
    """SELECT conv_id, turn, CAST(to_json({'data_source': 'talk', 'prompt': [{'role': role, 'content': md5(text)}],
        'extra_info': {'conv_id': conv_id, 'turn': turn}}) AS VARCHAR) AS record FROM conversations""",
)
def scl25(t):
    """Nested records as JSON."""
    record = F.struct(
        F.lit("talk").alias("data_source"),
        F.array(F.struct("role", F.md5("text").alias("content"))).alias("prompt"),
        F.struct("conv_id", "turn").alias("extra_info"),
    )
    return t["conversations"].select("conv_id", "turn", F.to_json(record).alias("record"))


@query(
    "scl27",
    """SELECT o_orderkey, 'Mức thay đổi của Tỷ lệ ' || lower(o_orderstatus) || ' trong quý ' || quarter(o_orderdate)
        || ' năm ' || year(o_orderdate) || ' là bao nhiêu %?' AS question FROM orders""",
)
def scl27(t):
    """Question text from a template."""
    text = ds.fill_template(
        ds.MACRO_QUESTION,
        item=F.lower("o_orderstatus"),
        quarter=F.quarter("o_orderdate"),
        year=F.year("o_orderdate"),
    )
    return t["orders"].select("o_orderkey", text.alias("question"))


# -- market, statement, ratio and macro questions -----------------------------------------

_DRAW = "CAST('0x' || substr(md5(identity || ':0'), 1, 8) AS BIGINT) % 100"
_GAP = f"""CASE WHEN is_quarter THEN CASE WHEN {_DRAW} < 45 THEN 3 WHEN {_DRAW} < 90 THEN 2 ELSE 1 END
    ELSE CASE WHEN {_DRAW} < 50 THEN 2 ELSE 1 END END"""


def asked(source: str) -> str:
    """SQL adding gap and ask date to rows with identity, year, time_val and is_quarter."""
    return f"""SELECT *, strftime(last_day(last_day(make_date(year, CASE WHEN is_quarter THEN time_val * 3 ELSE time_val END, 1))
        - to_months(CAST(gap AS INTEGER))), '%Y-%m-%d') AS time_asked
    FROM (SELECT *, CAST({_GAP} AS INTEGER) AS gap FROM {source})"""


_PERIOD_STATS = """
    SELECT series_key, CAST(year(time) AS INTEGER) AS year, CAST({p}(time) AS INTEGER) AS time_val, '{p}' AS period_type,
        avg(close) AS mean_close, stddev_samp(close) AS std_close, stddev_samp(daily_return) AS std_daily_return,
        count(time) AS duration, arg_max(close, time) AS q_close, arg_min(prev_close, time) AS start_close
    FROM returns GROUP BY ALL"""
def _market_sql(prefix: str, name: str) -> dict[str, str]:
    return {
        "returns": catalog_series._RETURNS,
        "stats": _PERIOD_STATS.format(p="quarter") + " UNION ALL " + _PERIOD_STATS.format(p="month"),
        "periods": f"""SELECT *, period_type = 'quarter' AS is_quarter,
            concat_ws('/', '{prefix}', series_key, year, period_type, time_val) AS identity FROM stats""",
        "dated": asked("periods"),
        "questions": f"""
          SELECT *, md5(identity || '/' || type) AS id FROM (
            SELECT identity, year, time_val, is_quarter, time_asked, gap, '{prefix}_return' AS type,
              'Tỷ suất sinh lời của ' || {name} || ' trong ' || CASE WHEN is_quarter THEN 'quý ' ELSE 'tháng ' END || time_val
                || ' năm ' || year || ' là bao nhiêu %?' AS question_raw,
              round((q_close - start_close) / nullif(start_close, 0) * 100, 2) AS answer,
              round(coalesce(std_daily_return * sqrt(duration), 0), 4) AS std FROM dated
            UNION ALL
            SELECT identity, year, time_val, is_quarter, time_asked, gap, '{prefix}_stats',
              'Giá trị trung bình và độ lệch chuẩn của ' || {name} || ' trong ' || CASE WHEN is_quarter THEN 'quý ' ELSE 'tháng ' END || time_val
                || ' năm ' || year || ' là bao nhiêu?',
              round(mean_close, 2), round(coalesce(round(std_close, 2), 0), 4) FROM dated)""",
    }


_MARKET = _market_sql("stock", "'cổ phiếu ' || series_key")


def statistics(t):
    return series.all_period_statistics(catalog_series.returns(t), KEY)


def market(t):
    return ds.market_questions(statistics(t), KEY, "stock", F.concat(F.lit(ds.STOCK_WORD + " "), F.col(KEY)))


def with_answer(df):
    return df.withColumn("answer", F.col("answer_raw").cast("double")).drop("answer_raw")


@query(
    "qa1",
    "SELECT id, type, year, time_val, is_quarter, question_raw, answer, std FROM questions",
    "bars",
    _MARKET,
)
def qa1(t):
    """Market questions with answers."""
    return with_answer(market(t)).select(
        "id", "type", "year", "time_val", "is_quarter", "question_raw", "answer", "std"
    )


_QUESTION = ("id", "type", "year", "time_val", "is_quarter", "question_raw", "answer", "std")


@query(
    "qa1_index",
    "SELECT id, type, year, time_val, is_quarter, question_raw, answer, std FROM questions",
    "bars",
    _market_sql("index", "'chỉ số ' || series_key"),
)
def qa1_index(t):
    """Questions about indices."""
    name = F.concat(F.lit(ds.INDEX_WORD + " "), F.col(KEY))
    return with_answer(ds.market_questions(statistics(t), KEY, "index", name)).select(*_QUESTION)


@query(
    "qa1_commodity",
    "SELECT id, type, year, time_val, is_quarter, question_raw, answer, std FROM questions",
    "bars",
    _market_sql("commodity", "CASE series_key WHEN '1-URGENT' THEN 'Vàng' WHEN '2-HIGH' THEN 'Dầu WTI' ELSE series_key END"),
)
def qa1_commodity(t):
    """Questions about commodities under their published names; the test series stand for two of them."""
    traded = F.when(F.col(KEY) == "1-URGENT", "Gold").when(F.col(KEY) == "2-HIGH", "Crude Oil WTI").otherwise(F.col(KEY))
    name = ds.renamed(traded, ds.COMMODITY_NAMES)
    return with_answer(ds.market_questions(statistics(t), KEY, "commodity", name)).select(*_QUESTION)


@query(
    "qa2",
    "SELECT id, time_asked, gap FROM questions",
    "bars",
    _MARKET,
)
def qa2(t):
    """Ask dates by weighted choice."""
    return market(t).select("id", "time_asked", "gap")


_STATEMENT_Q = {
    "chosen": """SELECT stock_code, category_code, year, quarter, segment, data, quarter AS time_val, true AS is_quarter,
        'financial_' || category_code AS type,
        concat_ws('/', 'financial_' || category_code, stock_code, category_code, year, quarter) AS identity
      FROM statement WHERE category_code IN ('IS_020', 'IS_100', 'BS_125', 'BS_300', 'Bank_TM_121', 'Bank_TM_45', 'Bank_TM_61', 'CF_130') AND year >= 1998 AND quarter > 0""",
    "dated": asked("chosen"),
}


@query(
    "qa3",
    """SELECT stock_code, category_code, type, time_asked, gap, md5(identity) AS id, data AS answer,
        CASE category_code WHEN 'IS_020' THEN 'Doanh thu' WHEN 'IS_100' THEN 'Lợi nhuận ròng' WHEN 'Bank_TM_121' THEN 'Tiền gửi không kỳ hạn' ELSE 'Tổng nợ phải trả' END
        || ' của ' || CASE segment WHEN 'bank' THEN 'ngân hàng ' ELSE 'công ty ' END || stock_code
        || ' trong quý ' || quarter || ' năm ' || year || ' là bao nhiêu tỷ VND?' AS question_raw FROM dated""",
    "statement",
    _STATEMENT_Q,
)
def qa3(t):
    """Questions about statement accounts."""
    rows = with_answer(ds.statement_questions(t.statement, first_year=1998))
    return rows.select(
        "stock_code", "category_code", "type", "time_asked", "gap", "id", "answer", "question_raw"
    )


_QA4_FAMILIES = ("liquidity", "profitability", "cashflow", "notes")
_RATIO_Q = ratio_sql.facts_views(catalog_ratios._TRAILING, False) | {
    "names": ratio_sql.names_values(),
    "every_ratio": ratio_sql.families_sql(_QA4_FAMILIES),
    "finished": catalog_ratios._FINISHED,
    "chosen": """SELECT *, quarter AS time_val, true AS is_quarter, 'ratio_' || ratio_code AS type,
        concat_ws('/', 'ratio_' || ratio_code, stock_code, ratio_code, year, quarter) AS identity
      FROM finished WHERE ratio_code IN ('NIM', 'BDR', 'ROE', 'ROA', 'EBITDA', 'DTTCR', 'QR', 'CashR')
        AND year >= 1998 AND quarter > 0""",
    "dated": asked("chosen"),
}


@query(
    "qa4",
    """SELECT stock_code, ratio_code, type, time_asked, gap, md5(identity) AS id, round(data, 4) AS answer,
        CASE ratio_code WHEN 'BDR' THEN 'Tỷ lệ nợ xấu' WHEN 'ROE' THEN 'Tỷ suất sinh lời trên vốn chủ sở hữu'
          WHEN 'ROA' THEN 'Tỷ suất sinh lời trên tổng tài sản' WHEN 'DTTCR' THEN 'Nợ trên tổng vốn chủ sở hữu'
          WHEN 'QR' THEN 'Khả năng nhanh toán nhanh' WHEN 'CashR' THEN 'Khả năng thanh toán nhanh bằng tiền mặt'
          ELSE ratio_code END
        || ' của ' || CASE segment WHEN 'bank' THEN 'ngân hàng ' ELSE 'công ty ' END || stock_code
        || ' trong quý ' || quarter || ' năm ' || year || ' là bao nhiêu?' AS question_raw FROM dated""",
    "statement prices",
    _RATIO_Q,
)
def qa4(t):
    """Questions about ratios."""
    stored, codes = catalog_ratios.stored_facts(t)
    ratios = st.stacked(
        *[
            ratio_tables.segment_ratios(stored[s], s, families=_QA4_FAMILIES, codes=codes[s]).drop("family")
            for s in SEGMENTS
        ]
    )
    rows = with_answer(ds.ratio_questions(ratios, first_year=1998))
    return rows.select("stock_code", "ratio_code", "type", "time_asked", "gap", "id", "answer", "question_raw")


@query(
    "qa4_banks",
    """SELECT stock_code, ratio_code, type, time_asked, gap, md5(identity) AS id, round(data, 4) AS answer,
        CASE ratio_code WHEN 'BDR' THEN 'Tỷ lệ nợ xấu' ELSE ratio_code END || ' của ngân hàng ' || stock_code
        || ' trong quý ' || quarter || ' năm ' || year || ' là bao nhiêu?' AS question_raw FROM dated""",
    "statement prices",
    _RATIO_Q
    | {
        "chosen": """SELECT *, quarter AS time_val, true AS is_quarter, 'bank_ratio_' || ratio_code AS type,
            concat_ws('/', 'bank_ratio_' || ratio_code, stock_code, ratio_code, year, quarter) AS identity
          FROM finished WHERE segment = 'bank' AND ratio_code IN ('NIM', 'BDR') AND year >= 1998 AND quarter > 0""",
    },
)
def qa4_banks(t):
    """Questions about the ratios of banks."""
    stored, codes = catalog_ratios.stored_facts(t)
    ratios = ratio_tables.segment_ratios(stored["bank"], "bank", families=_QA4_FAMILIES, codes=codes["bank"])
    rows = ds.ratio_questions(ratios.drop("family"), ds.BANK_RATIO_ITEMS, first_year=1998, banks_only=True)
    return with_answer(rows).select(
        "stock_code", "ratio_code", "type", "time_asked", "gap", "id", "answer", "question_raw"
    )


@query(
    "qa5",
    """SELECT country, indicator_name, type, time_asked, gap, md5(identity) AS id, round(increase_pct, 2) AS answer, question_raw
    FROM dated""",
    "macro",
    {
        "changes": catalog_series._CHANGES,
        "chosen": """SELECT *, (q_close - prev_close) / prev_close * 100 AS increase_pct, quarter AS time_val, true AS is_quarter,
            lower('macro_' || split_part(indicator_name, '_', 1)) AS type,
            concat_ws('/', lower('macro_' || split_part(indicator_name, '_', 1)), country, indicator_name, year, quarter) AS identity,
            'Mức thay đổi của Tỷ lệ ' || CASE WHEN indicator_name LIKE '%Inflation%' THEN 'lạm phát' ELSE 'thất nghiệp' END
            || ' trong quý ' || quarter || ' năm ' || year || ' là bao nhiêu %?' AS question_raw FROM changes""",
        "dated": asked("chosen"),
    },
)
def qa5(t):
    """Questions about the change of macro indicators."""
    changes = series.period_close_change(t.macro, ["country", "indicator_name"], "datetime", "value")
    rows = with_answer(ds.macro_questions(changes, ["country", "indicator_name"]))
    return rows.select("country", "indicator_name", "type", "time_asked", "gap", "id", "answer", "question_raw")


BOUNDARY, VALIDATION = "1999-09-30", ("1999-09-30", "1999-06-30")
_SPLIT = """CASE WHEN time_asked IN ('1999-09-30', '1999-06-30') THEN 'val' WHEN time_asked < '1999-09-30' THEN 'train' ELSE 'test' END"""


@query("qa6", f"SELECT id, time_asked, {_SPLIT} AS split FROM questions", "bars", _MARKET)
def qa6(t):
    """Splits by ask date."""
    split = ds.split_of(F.col("time_asked"), BOUNDARY, VALIDATION)
    return market(t).select("id", "time_asked", split.alias("split"))


@query(
    "qa6_overlap",
    """SELECT id, 'train' AS split FROM questions WHERE time_asked < '1999-09-30'
    UNION ALL SELECT id, 'val' FROM questions WHERE time_asked IN ('1999-09-30', '1999-06-30')
    UNION ALL SELECT id, 'test' FROM questions WHERE time_asked > '1999-09-30'""",
    "bars",
    _MARKET,
)
def qa6_overlap(t):
    """Splits with an early validation date kept in training."""
    return ds.overlapping_splits(market(t), BOUNDARY, VALIDATION).select("id", "split")


def split_questions(t):
    split = ds.split_of(F.col("time_asked"), BOUNDARY, VALIDATION)
    return ds.with_running_index(market(t).withColumn("split", split))


_INDEXED = f"""
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(id || ':0')) - 1 AS index
    FROM (SELECT *, {_SPLIT} AS split FROM questions)"""


@query(
    "qa7",
    """SELECT 'questions' AS data_source, 'user' AS role, question_raw AS content, 'math' AS ability, 'rule' AS style,
        answer AS mean, coalesce(std, 0) AS std, split, index, time_asked, CAST(gap AS BIGINT) AS gap, type AS question_type, id
    FROM indexed WHERE answer IS NOT NULL""",
    "bars",
    _MARKET | {"indexed": _INDEXED},
)
def qa7(t):
    """Nested question records, flattened for comparison."""
    records = ds.as_records(split_questions(t))
    return records.select(
        "data_source",
        F.col("prompt")[0]["role"].alias("role"),
        F.col("prompt")[0]["content"].alias("content"),
        "ability",
        F.col("reward_model.style").alias("style"),
        F.col("reward_model.ground_truth.mean").alias("mean"),
        F.col("reward_model.ground_truth.std").alias("std"),
        *[F.col(f"extra_info.{c}").alias(c) for c in ("split", "index", "time_asked", "gap", "question_type", "id")],
    )


PREFERRED = [f"S{i}" for i in range(10, 100, 7)]


@query(
    "qa8",
    f"""SELECT id, question_raw FROM q WHERE ticker IS NULL
    UNION ALL SELECT id, question_raw FROM (
      SELECT *, row_number() OVER (ORDER BY CASE WHEN ticker IN ({', '.join(f"'{p}'" for p in PREFERRED)}) THEN 0 ELSE 1 END, md5(id || ':0')) AS n
      FROM q WHERE ticker IS NOT NULL) WHERE n <= 500""",
    "statement",
    _STATEMENT_Q
    | {
        "q": """SELECT *, nullif(regexp_extract(question_raw, '(?:công ty|cổ phiếu|ngân hàng)\\s+([A-Z0-9]{3})\\b', 1), '') AS ticker
          FROM (SELECT md5(identity) AS id, CASE category_code WHEN 'IS_020' THEN 'Doanh thu' WHEN 'IS_100' THEN 'Lợi nhuận ròng' WHEN 'Bank_TM_121' THEN 'Tiền gửi không kỳ hạn' ELSE 'Tổng nợ phải trả' END
            || ' của ' || CASE segment WHEN 'bank' THEN 'ngân hàng ' ELSE 'công ty ' END || stock_code
            || ' trong quý ' || quarter || ' năm ' || year || ' là bao nhiêu tỷ VND?' AS question_raw FROM dated)""".replace(
            "\\\\", "\\"
        )
    },
)
def qa8(t):
    """Question set thinned to a quota of company questions, preferred companies first."""
    questions = ds.statement_questions(t.statement, first_year=1998)
    marks = ds.entity_marks(F.col("question_raw"), F.col("type"), PREFERRED)
    return sampling.quota_sample(questions, F.col("id"), quota=500, **marks).select("id", "question_raw")


def json_lines(t):
    """One JSON line per event: proper records and several kinds of damage."""
    i = F.col("event_id")
    q = '"'
    good = F.concat(
        F.lit('{"data_source":"web","prompt":[{"role":"user","content":"q'),
        i.cast("string"),
        F.lit('"},5,{"role":"assistant"}],"ability":null,"reward_model":{"style":"rule","ground_truth":'),
        F.when(i % 2 == 0, F.lit('{"mean":1.5,"std":"0.25"}')).otherwise(
            F.lit('"{\\"mean\\": 2.5}"')
        ),
        F.lit('},"extra_info":{"index":"7","gap":'),
        (i % 3).cast("string"),
        F.lit(',"id":"e'),
        i.cast("string"),
        F.lit(q + "}}"),
    )
    line = (
        F.when(i % 6 == 0, F.lit("[1, 2]"))
        .when(i % 6 == 1, F.concat(F.lit('{"extra_info":{"id":"e'), i.cast("string"), F.lit('"},"prompt":"x","reward_model":3}')))
        .when(i % 6 == 2, F.lit('{"data_source": "cut'))
        .otherwise(good)
    )
    return t["events"].select(line.alias("value"))


@query(
    "qa9",
    """SELECT CASE WHEN full_ THEN 'web' ELSE '' END AS data_source, CAST(CASE WHEN full_ THEN 2 ELSE 0 END AS INTEGER) AS messages,
        CASE WHEN full_ THEN 'user|assistant' ELSE '' END AS roles, CASE WHEN full_ THEN 'q' || event_id || '|' ELSE '' END AS contents,
        '' AS ability, CASE WHEN full_ THEN 'rule' ELSE '' END AS style,
        CASE WHEN full_ THEN CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 2.5 END END::DOUBLE AS mean,
        CASE WHEN full_ AND event_id % 2 = 0 THEN 0.25 END::DOUBLE AS std,
        CASE WHEN full_ THEN 7 END::BIGINT AS index, CASE WHEN full_ THEN event_id % 3 END AS gap, 'e' || event_id AS id
    FROM (SELECT event_id, event_id % 6 > 2 AS full_ FROM events WHERE event_id % 6 NOT IN (0, 2))""",
)
def qa9(t):
    """Foreign records normalised to the fixed schema, flattened for comparison."""
    rows = ds.normalised_records(json_lines(t))
    return rows.select(
        "data_source",
        F.size("prompt").alias("messages"),
        F.array_join(F.transform("prompt", lambda m: m["role"]), "|").alias("roles"),
        F.array_join(F.transform("prompt", lambda m: m["content"]), "|").alias("contents"),
        "ability",
        F.col("reward_model.style").alias("style"),
        F.col("reward_model.ground_truth.mean").alias("mean"),
        F.col("reward_model.ground_truth.std").alias("std"),
        F.col("extra_info.index").alias("index"),
        F.col("extra_info.gap").alias("gap"),
        F.col("extra_info.id").alias("id"),
    )


@query(
    "scl26",
    """SELECT 'e' || event_id AS id, (CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 2.5 END)::DOUBLE AS mean FROM events WHERE event_id % 6 > 2""",
)
def scl26(t):
    """Ground truth given as an object or as JSON text."""
    rows = ds.normalised_records(json_lines(t)).where("reward_model.style = 'rule'")
    return rows.select(
        F.col("extra_info.id").alias("id"), F.col("reward_model.ground_truth.mean").alias("mean")
    )


@query(
    "qa10",
    """SELECT 'math' AS data_source, question || ' ' || 'Let''s think step by step and output the final answer after "####".' AS content,
        replace(regexp_extract(answer, '#### (\\-?[0-9\\.\\,]+)', 1), ',', '') AS ground_truth, split,
        row_number() OVER (PARTITION BY split ORDER BY item_id) - 1 AS index
    FROM (SELECT item_id, text AS question, 'so #### ' || item_id || ',' || '000' AS answer,
          CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM benchmark)""".replace("\\\\", "\\"),
)
def qa10(t):
    """Problem records with extracted solutions and a running index per split."""
    problems = t["benchmark"].select(
        "item_id",
        F.col("text").alias("question"),
        F.concat(F.lit("so #### "), F.col("item_id").cast("string"), F.lit(",000")).alias("answer"),
    )
    split = F.when(F.col("item_id") % 4 == 0, "test").otherwise("train")
    records = ds.math_records(problems, split, "item_id", bucket_rows=8)
    return records.select(
        "data_source",
        F.col("prompt")[0]["content"].alias("content"),
        F.col("reward_model.ground_truth").alias("ground_truth"),
        F.col("extra_info.split").alias("split"),
        F.col("extra_info.index").alias("index"),
    )


def talks(t):
    """Conversations as prompt records; some start with a system message."""
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return (
        t["conversations"]
        .groupBy("conv_id")
        .agg(
            F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("prompt")
        )
        .withColumn(
            "extra_info",
            F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("time_asked")),
        )
    )


_TALKS = """
    SELECT conv_id, arg_min(role, turn) AS first_role, arg_min(text, turn) AS first_text, count(*) AS n FROM conversations GROUP BY 1"""


@query(
    "scl29",
    """SELECT conv_id, CAST(CASE WHEN first_role = 'system' THEN n ELSE n + 1 END AS INTEGER) AS messages, 'system' AS first_role FROM talks""",
    extra={"talks": _TALKS},
)
def scl29(t):
    """System message put in front where there is none."""
    rows = ds.with_system_prompt(talks(t), "Be brief.")
    return rows.select(
        "conv_id", F.size("prompt").alias("messages"), F.col("prompt")[0]["role"].alias("first_role")
    )


@query(
    "qa11",
    """SELECT conv_id, 'finance' AS ability, CASE WHEN first_role = 'system' THEN first_text
        ELSE 'Today is 2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || '.' END AS content FROM talks""",
    extra={"talks": _TALKS},
)
def qa11(t):
    """System prompts filled with the ask date; ability replaced."""
    rows = ds.with_system_prompt(talks(t), "Today is {current_time}.")
    return rows.select("conv_id", "ability", F.col("prompt")[0]["content"].alias("content"))


# -- sampling -------------------------------------------------------------------------------


@query("smp1", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || ':7') LIMIT 4000")
def smp1(t):
    """Uniform sample of a stated size."""
    rows = t["orders"].select("o_orderkey", "o_custkey")
    return sampling.sample(rows, F.col("o_orderkey"), 4000, seed=7)


@query(
    "smp2",
    "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':3')) - 1 AS index FROM documents",
)
def smp2(t):
    """Each part shuffled and numbered."""
    return ds.with_running_index(t["documents"].select("doc_id", "lang"), "lang", "doc_id", seed=3)


@query(
    "smp3",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT c_custkey, c_mktsegment FROM (
      SELECT *, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, md5(c_custkey || ':1')) AS n
      FROM customer WHERE c_mktsegment <> 'MACHINERY') WHERE n <= 600""",
)
def smp3(t):
    """Quota filled from a preferred class first; the rest untouched."""
    segment = F.col("c_mktsegment")
    return sampling.quota_sample(
        t["customer"].select("c_custkey", "c_mktsegment"),
        F.col("c_custkey"),
        segment != "MACHINERY",
        segment == "BUILDING",
        quota=600,
        seed=1,
    )
