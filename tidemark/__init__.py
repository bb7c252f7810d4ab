"""Tidemark: financial series, statement, news and question-set operators on Spark DataFrames."""

from tidemark.session import build_session

__all__ = ["build_session"]
