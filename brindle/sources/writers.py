"""Result writers: boxed table, plain text, HTML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from html import escape

from pyspark.sql import DataFrame


def cell(value) -> str:
    """Text of a value: NULL, true and false in lower case, doubles with six significant digits."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:g}"
    return str(value)


def plain(rows: Iterable[Sequence]) -> str:
    """One line for each row, cells parted by a blank."""
    return "\n".join(" ".join(cell(v) for v in row) for row in rows)


def boxed(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A table with borders, columns as wide as their widest cell."""
    body = [[cell(v) for v in row] for row in rows]
    widths = [max([len(n), *(len(r[i]) for r in body)]) for i, n in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(cells, widths, strict=True)) + "|"
    return "\n".join([rule, line(names), rule, *map(line, body), rule])


def html(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(cell(v))}</td>" for v in row) + "</tr>" for row in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def render(df: DataFrame, style: str = "table", limit: int | None = None) -> str:
    """The rows of df as text; limit bounds what comes to the driver."""
    rows = (df if limit is None else df.limit(limit)).collect()
    if style == "plain":
        return plain(rows)
    return (html if style == "html" else boxed)(df.columns, rows)
