"""Row changes as transforms of an immutable table: the old one is read, a new one comes out.

Every right-hand side and condition sees the old rows, so an update can never meet its own results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table and the new rows; columns not named are null."""
    given = columns or table.columns
    if len(given) != len(rows.columns):
        raise ValueError("number of inserted columns doesn't match")
    named = rows.toDF(*given)
    cast = [named[c].cast(table.schema[c].dataType).alias(c) if c in given else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return table.unionByName(named.select(*cast))


def update(table: DataFrame, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """All rows, with changes where the condition is true."""
    unknown = set(changes) - set(table.columns)
    if unknown:
        raise ValueError(f"no column {sorted(unknown)[0]}")
    hit = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
    new = {c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}
    return table.select(*(new.get(c, F.col(c)).alias(c) for c in table.columns))


def delete(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows for which the condition isn't true; without one, none."""
    return table.where(~F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(False))
