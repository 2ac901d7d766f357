"""Filters on text and checks on inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import is_nonblank

MIN_UNIT = 2


def drop_blank(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Keep rows whose text has a non-whitespace character; nulls and blanks go."""
    return df.where(F.col(text_column).isNotNull() & is_nonblank(F.col(text_column)))


def preview(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """The first ``count`` rows: a bounded top-k, not a full sort."""
    return df.orderBy(*order).limit(count)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise ``ValueError`` when ``df`` is empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_value(value, message: str):
    if value is None or value == "":
        raise ValueError(message)
    return value


def min_unit(min_len: int) -> int:
    """Shortest useful sequence: at least two tokens."""
    return max(MIN_UNIT, min_len)


def checked(column: Column, condition: Column, message: str) -> Column:
    """``column`` where ``condition`` holds; fails the job otherwise."""
    return F.when(condition, column).otherwise(F.raise_error(F.lit(message)))
