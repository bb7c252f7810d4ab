"""Small helpers of the corpus operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: White space of all contracts here: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def broadcast_if_small(table: DataFrame, most_rows: int) -> tuple[DataFrame, bool]:
    """``table`` with a broadcast hint if it has at most ``most_rows`` rows.

    The table should be a stored one: counting it then reads only footers.
    """
    small = table.count() <= most_rows
    return (F.broadcast(table) if small else table), small


def folded_bytes(text: str | None) -> bytes:
    """UTF-8 of ``text`` with A-Z in lower case (nothing else is folded)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


ASCII_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
