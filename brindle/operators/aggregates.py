"""Grouped, scalar and distinct aggregation, and exact table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_star() -> Column:
    return F.count(F.lit(1))


def aggregate(df: DataFrame, keys: Sequence[Column | str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """Groups by keys (none: one row over everything, also over no rows), then keeps groups for which having holds.

    Nulls form one group. Partial sums are made before the shuffle, so a key that holds most rows
    sends no more than one row from each task.
    """
    columns = [c.alias(n) for n, c in aggregates.items()]
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out if having is None else out.where(having)


def analyze(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact row count and distinct non-null values: column_name, n_distinct, cardinality, one row for each column.

    All columns are counted in one aggregation over values of their own types, made distinct before they are shuffled.
    """
    columns = list(columns or df.columns)
    counts = [F.count_distinct(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    found = df.agg(count_star().alias("cardinality"), *counts)
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_distinct")) for i, c in enumerate(columns)))
    return found.select(F.explode(pairs).alias("p"), "cardinality").select("p.*", "cardinality")
