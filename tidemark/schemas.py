"""Table schemas: statement and ratio facts, series, dimensions, news and question records."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*columns: tuple) -> T.StructType:
    """Build a schema from (name, type[, required]) tuples."""
    return T.StructType(
        [T.StructField(c[0], c[1], not (len(c) > 2 and c[2] == "required")) for c in columns]
    )


_S, _D, _L, _I, _TS, _B = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.TimestampType(),
    T.BooleanType(),
)

STATEMENT = _fields(
    ("stock_code", _S, "required"),
    ("category_code", _S, "required"),
    ("data", _D),
    ("year", _I),
    ("quarter", _I),
    ("date_added", _TS, "required"),
    ("segment", _S, "required"),
)

RATIO = _fields(
    ("stock_code", _S, "required"),
    ("ratio_code", _S, "required"),
    ("data", _D),
    ("year", _I),
    ("quarter", _I),
    ("date_added", _TS, "required"),
    ("segment", _S, "required"),
)

COMPANY = _fields(
    ("stock_code", _S, "required"),
    ("company_name", _S),
    ("short_name", _S),
    ("en_company_name", _S),
    ("en_short_name", _S),
    ("combine_profile", _S),
    ("industry", _S),
    ("exchange", _S),
    ("foreign_percent", _D),
    ("issue_share", _D),
    ("no_shareholders", _L),
    ("stock_rating", _D),
    ("website", _S),
    ("stock_indices", _S),
    ("is_bank", _B),
    ("is_securities", _B),
    ("market_cap", _D),
)

ACCOUNT_DIM = _fields(("category_code", _S, "required"), ("category_name", _S))
RATIO_DIM = _fields(("ratio_code", _S, "required"), ("ratio_name", _S), ("function_name", _S))


def series(key: str, spans: tuple[int, ...]) -> T.StructType:
    """Price or index bars: ``time, close, volume, key, EMA…`` (20/50/200 daily, 12/26 monthly)."""
    return _fields(
        ("time", _TS, "required"),
        ("close", _D, "required"),
        ("volume", _L),
        (key, _S, "required"),
        *((f"EMA{s}", _D) for s in spans),
    )


def commodity(spans: tuple[int, ...]) -> T.StructType:
    return _fields(
        ("time", _TS, "required"),
        ("indicator_code", _S, "required"),
        ("indicator_name", _S, "required"),
        ("value", _D, "required"),
        ("volume", _L),
        *((f"EMA{s}", _D) for s in spans),
    )


MACRO = _fields(
    ("datetime", _TS, "required"),
    ("duration", _S, "required"),
    ("indicator_name", _S, "required"),
    ("country", _S, "required"),
    ("value", _D, "required"),
    ("unit", _S, "required"),
)

NEWS = _fields(
    ("url", _S, "required"),
    ("source", _S, "required"),
    ("title", _S, "required"),
    ("pub_date", _TS, "required"),
    ("channel_name", _S, "required"),
    ("channel_id", _L, "required"),
    ("created_at", _TS, "required"),
    ("updated_at", _TS, "required"),
    ("text", _S),
    ("summarize", _S),
    ("vectorized", _B),
)

MESSAGE = _fields(("role", _S), ("content", _S))
GROUND_TRUTH = _fields(("mean", _D), ("std", _D))
QUESTION = _fields(
    ("data_source", _S),
    ("prompt", T.ArrayType(MESSAGE)),
    ("ability", _S),
    ("reward_model", _fields(("style", _S), ("ground_truth", GROUND_TRUTH))),
    (
        "extra_info",
        _fields(
            ("split", _S),
            ("index", _L),
            ("time_asked", _S),
            ("gap", _L),
            ("question_type", _S),
            ("std", _D),
            ("id", _S),
        ),
    ),
)


def required_columns(schema: T.StructType) -> list[str]:
    """Names of the REQUIRED columns, used for the null drop before a load."""
    return [f.name for f in schema.fields if not f.nullable]
