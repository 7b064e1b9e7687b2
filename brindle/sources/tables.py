"""Scans of Parquet tables, inline values, and the one-row relation of a SELECT without FROM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None) -> DataFrame:
    """A table's rows; columns and predicates used above reach the Parquet reader through Catalyst."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.alias(alias) if alias else df


def values(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """An inline table, made of literals. All rows are checked against the schema, not only the first."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    check = T._make_type_verifier(kind)
    for i, row in enumerate(rows):
        if len(row) != len(kind.fields):
            raise ValueError(f"VALUES row {i + 1} has {len(row)} items, not {len(kind.fields)}")
        check(tuple(row))
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
    structs = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields, strict=True))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def one_row(spark: SparkSession, **columns: Column) -> DataFrame:
    """SELECT without FROM: one row of expressions."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items()))


def catalog_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    """The system table of tables: table_name, schema (name and type of each column, in order) and cardinality."""
    parts = []
    for name in names:
        df = scan(spark, sf_dir, name)
        described = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        parts.append(df.agg(F.count(F.lit(1)).alias("cardinality")).select(F.lit(name).alias("table_name"), F.lit(described).alias("schema"), "cardinality"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
