"""Scalar operators and functions whose rules differ from Spark's defaults, as Column expressions.

All stay within whole-stage code generation; none is a Python function over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOL_WORDS = {"t": True, "f": False}


def int_div(a: Column, b: Column, kind: str = "int") -> Column:
    """Quotient of integers, cut off towards zero, as an int (or bigint); a zero divisor is an error."""
    # Under ANSI, casting checks the one case that overflows (the least integer by -1).
    return F.call_function("div", a, b).cast(kind)


def divide(a: Column, b: Column) -> Column:
    """Quotient of doubles."""
    return a.cast("double") / b.cast("double")


def byte_length(s: Column) -> Column:
    """Bytes of the string in UTF-8."""
    return F.octet_length(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def between(x: Column, low, high) -> Column:
    return x.between(low, high)


def in_list(x: Column, items: Sequence) -> Column:
    """Three-valued: null if nothing equals x and an item is null."""
    return x.isin(*items)


def like(s: Column, pattern: str) -> Column:
    """% stands for any characters, _ for one character; nothing else is special."""
    return s.like(pattern.replace("\\", "\\\\"))


def to_bool(x: Column) -> Column:
    """'t' and 'f' as booleans; any other string is an error, null stays null."""
    word = x.cast("string")
    return F.when(word == "t", F.lit(True)).when(word == "f", F.lit(False)).when(word.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), word)).cast("boolean"))


def exact_sum(x: Column, precision: int = 18, scale: int = 2) -> Column:
    """Sum of doubles that hold decimals of that scale, free of rounding by order, as a double."""
    return F.sum(x.cast(f"decimal({precision},{scale})")).cast("double")


def money(x: Column, precision: int = 12, scale: int = 2) -> Column:
    """A double that holds a decimal, as that decimal."""
    return x.cast(f"decimal({precision},{scale})")
