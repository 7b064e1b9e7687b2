"""Joins, with a choice of algorithm, and a greedy left-deep join order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a forced algorithm is called in Spark; ``none`` leaves the choice to Catalyst and adaptive execution.
HINTS = {"none": None, "merge": "merge", "hash": "shuffle_hash"}
KINDS = ("inner", "left", "right", "full", "semi", "anti")
#: Estimated bytes up to which a side may be broadcast on request.
BROADCAST_BYTES = 64 << 20


def hinted(df: DataFrame, algorithm: str = "none") -> DataFrame:
    if algorithm not in HINTS:
        raise ValueError(f"no join algorithm {algorithm}")
    hint = HINTS[algorithm]
    return df.hint(hint) if hint else df


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", algorithm: str = "none") -> DataFrame:
    """All columns of left, then of right; any boolean condition."""
    if how not in KINDS:
        raise ValueError(f"no join {how}")
    return left.join(hinted(right, algorithm), on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def join_using(left: DataFrame, right: DataFrame, column: str, how: str = "inner", algorithm: str = "none") -> DataFrame:
    """Equality of one column of the same name; both copies stay, the right one as right_<column>."""
    other = f"right_{column}"
    renamed = right.withColumnRenamed(column, other)
    return join(left, renamed, left[column] == renamed[other], how, algorithm)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def estimated_bytes(df: DataFrame) -> int:
    """Size of df as the optimizer estimates it; very large if it doesn't know."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_checked(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts right if its estimated size is bounded by ``most``, and otherwise joins by shuffle."""
    small = estimated_bytes(right) <= most
    return join(left, F.broadcast(right) if small else right, on, how)


class Relation:
    """A table for ``greedy_join``: its rows and its statistics (row count, distinct values by column)."""

    def __init__(self, name: str, df: DataFrame, rows: int, distinct: dict[str, int]):
        self.name, self.df, self.rows, self.distinct = name, df, rows, distinct


def greedy_order(relations: Sequence[Relation], links: Sequence[tuple[str, str, str]]) -> list[str]:
    """A left-deep order of relations linked by (one, other, shared column).

    Begins with the relation that has the most links, the smallest of those; then always adds the
    linked relation that leaves the smallest estimate, |R| |S| / max(V(R, c), V(S, c)) for each
    shared column c. Ties go by the order given. Unlinked relations come last.
    """
    known = {r.name: r for r in relations}
    place = {r.name: i for i, r in enumerate(relations)}
    degree = {n: sum(n in link[:2] for link in links) for n in known}
    first = min(known, key=lambda n: (-degree[n], known[n].rows, place[n]))
    order, rows, distinct = [first], float(known[first].rows), dict(known[first].distinct)
    while len(order) < len(known):
        best = None
        for name in known:
            if name in order:
                continue
            columns = {c for a, b, c in links if (a == name and b in order) or (b == name and a in order)}
            estimate = rows * known[name].rows
            for c in columns:
                estimate /= max(distinct.get(c, 1), known[name].distinct.get(c, 1))
            rank = (not columns, estimate, place[name])
            if best is None or rank < best[0]:
                best = rank, name, estimate
        _, name, rows = best
        for c, v in known[name].distinct.items():
            distinct[c] = min(v, distinct.get(c, v))
        order.append(name)
    return order


def greedy_join(relations: Sequence[Relation], links: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The relations joined in greedy order; each column appears as <relation>_<column>."""
    known = {r.name: r.df.toDF(*(f"{r.name}_{c}" for c in r.df.columns)) for r in relations}
    order = greedy_order(relations, links)
    out, seen = known[order[0]], {order[0]}
    for name in order[1:]:
        on = [F.col(f"{a}_{c}") == F.col(f"{b}_{c}") for a, b, c in links if {a, b} <= seen | {name} and name in (a, b)]
        condition = on[0] if on else F.lit(True)
        for more in on[1:]:
            condition = condition & more
        out = out.join(known[name], condition)
        seen.add(name)
    return out
