"""Projection, filter, distinct, sort, limit: the operators with one input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """The given expressions under their names, in order."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; false and null both drop a row."""
    return df.where(condition)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def order_by(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    """Sorts by keys, each a name or (name, "asc" | "desc"); nulls come last in either direction."""
    return df.orderBy(*(_key(k) for k in keys))


def _key(key: str | tuple[str, str]) -> Column:
    name, way = (key, "asc") if isinstance(key, str) else key
    return F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    """Rows after the first ``offset``, ``count`` at most. After a sort, Spark keeps only the rows asked for in each task."""
    if offset < 0:
        raise ValueError("OFFSET must not be negative")
    if count is not None and count < 0:
        raise ValueError("LIMIT must not be negative")
    out = df.offset(offset) if offset else df
    return out if count is None else out.limit(count)


def star(df: DataFrame, *before: Column) -> DataFrame:
    """Further expressions, then every column."""
    return df.select(*before, "*")


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)
