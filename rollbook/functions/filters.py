"""Optional filters and input cleaning.

A filter value of ``None`` or of empty text means "no restriction"; zero, also as
text, is a real bound, and so is a blank that is not empty. The equality filters also
take a one-column DataFrame and then keep the rows whose value occurs in it, which
answers one call per listed value in a single distributed pass.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNGRADED_LABEL = "未录入"


def given(value: Any) -> bool:
    """Whether a filter restricts: ``None`` and empty text do not."""
    return value is not None and not (isinstance(value, str) and value == "")


def number(value: Any) -> Any:
    """A bound given as text, as a whole number; raises if it is none."""
    return int(value) if isinstance(value, str) else value


def opt_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Keep rows whose ``column`` equals ``value``."""
    if not given(value):
        return df
    if isinstance(value, DataFrame):
        wanted = value.select(F.col(value.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi")
    return df.filter(F.col(column) == F.lit(value))


def opt_eq_text(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Like :func:`opt_eq`, ignoring case."""
    if not given(value):
        return df
    if isinstance(value, DataFrame):
        wanted = value.select(F.lower(value.columns[0]).alias("_wanted"))
        return df.join(wanted, F.lower(df[column]) == wanted["_wanted"], "left_semi")
    return df.filter(same_text(column, value))


def same_text(column: str | Column, text: str) -> Column:
    """Case-insensitive equality with a fixed text."""
    return F.lower(column) == F.lower(F.lit(text))


def fuzzy(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Keep rows whose ``column`` contains ``text``, ignoring case.

    ``%`` and ``_`` in ``text`` stand for themselves.
    """
    if not given(text):
        return df
    return df.filter(F.lower(column).contains(F.lower(F.lit(text))))


def opt_between(df: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    """Keep rows with ``low <= column <= high``; either end may be open.

    Bounds may be text: the form they come from sends text.
    """
    if given(low):
        df = df.filter(F.col(column) >= F.lit(number(low)))
    if given(high):
        df = df.filter(F.col(column) <= F.lit(number(high)))
    return df


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn empty text into NULL. Spaces are text and stay."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def to_int(df: DataFrame, columns: list[str]) -> DataFrame:
    """Read whole numbers as INT; other text and numbers become NULL."""

    def whole(column: str) -> Column:
        value, kind = F.col(column), df.schema[column].dataType
        if isinstance(kind, T.StringType):
            value = F.when(value.rlike(r"^-?\d+$"), value)
        elif isinstance(kind, T.FractionalType):
            value = F.when(value == F.floor(value), value)
        return value.try_cast(T.IntegerType())

    return df.withColumns({c: whole(c) for c in columns})


def with_null_label(df: DataFrame, label: str = UNGRADED_LABEL) -> DataFrame:
    """Report view: every column as text, with ``label`` for NULL."""
    return df.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit(label)).alias(c) for c in df.columns)
    )


def with_zero_defaults(df: DataFrame) -> DataFrame:
    """Card view: zero for every missing number."""
    return df.fillna(0)
