"""Filters and projections. Each one is a narrow step that reaches the scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions import all_of, modulo


def clean_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every column is above zero; a NULL drops the row."""
    return df.filter(all_of([F.col(c) > 0 for c in cols]))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(all_of([F.col(c).isNotNull() for c in cols]))


def exclude_values(df: DataFrame, col: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(~F.col(col).isin(list(values)))


def in_range(df: DataFrame, col: str, lo: Any, hi: Any) -> DataFrame:
    """Half-open range: ``lo <= col < hi``."""
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def equals(df: DataFrame, col: str, value: Any) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def maybe_equals(df: DataFrame, col: str, value: Any = None) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else equals(df, col, value)


def buckets(df: DataFrame, key: str, n: int, name: str = "bucket") -> DataFrame:
    """All rows with the remainder of their key: every bucket filter in one pass."""
    return df.withColumn(name, modulo(F.col(key), n).cast("int"))


def bucket(df: DataFrame, col: str, divisor: int, rest: int) -> DataFrame:
    return df.filter(modulo(F.col(col), divisor) == rest)


def project(df: DataFrame, spec: Mapping[str, str | Column]) -> DataFrame:
    """Select new name -> expression (SQL text or Column)."""
    return df.select(*[_column(e).alias(name) for name, e in spec.items()])


def derive(df: DataFrame, spec: Mapping[str, str | Column]) -> DataFrame:
    """Add columns and keep the others."""
    return df.withColumns({name: _column(e) for name, e in spec.items()})


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication; each task drops its own copies before the shuffle."""
    return df.dropDuplicates()


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run whole-table steps one after the other."""
    for step in steps:
        df = df.transform(step)
    return df


def _column(expr: str | Column) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr
