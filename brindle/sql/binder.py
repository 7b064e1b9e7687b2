"""Binds syntax trees to DataFrames.

Every column of the FROM clause gets a name of its own (c0, c1, ...), so Catalyst never has to guess
which side of a join is meant; expressions become Columns over those names, with the dialect's types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.operators.joins import Relation, greedy_order, hinted
from brindle.sources.snapshots import KEYS
from brindle.sql import syntax as X
from brindle.sql.errors import EngineError

_NUMBERS = ("int", "double", "uint")
_SPARK = {"int": "int", "double": "double", "string": "string", "bool": "boolean", "uint": "bigint", "null": "void"}
KIND_OF = {"int": "int", "double": "double", "char": "string", "varchar": "string", "uint": "uint", "bool": "bool", "other": "other"}


@dataclass(frozen=True)
class Field:
    table: str
    name: str
    column: str
    kind: str


@dataclass
class Scope:
    df: DataFrame
    fields: list[Field]
    aliases: dict[str, object] | None = None  # of the select list
    keys: tuple[str, str] | None = None  # the row key's columns, for a single table

    def resolve(self, ref: X.Ref) -> Field | object:
        found = [f for f in self.fields if f.name == ref.column and ref.table in (None, f.table)]
        alias = self.aliases.get(ref.column) if self.aliases and ref.table is None else None
        own = isinstance(alias, X.Ref) and len(found) == 1 and self._same(alias, found[0])
        if alias is not None and found and not own:
            raise EngineError(f'"{ref.column}" is both a column and an alias')
        if len(found) > 1:
            raise EngineError(f'column "{ref.column}" is ambiguous')
        if found:
            return found[0]
        if alias is not None:
            return alias
        raise EngineError(f'column "{ref.table + "." if ref.table else ""}{ref.column}" does not exist')

    def _same(self, ref: X.Ref, field: Field) -> bool:
        return [f for f in self.fields if f.name == ref.column and ref.table in (None, f.table)] == [field]


def literal(value, kind: str) -> Column:
    return F.lit(value).cast(_SPARK[kind]) if kind != "null" else F.lit(None)


def name_of(e) -> str:
    """The name of an output column that has no alias."""
    if isinstance(e, X.Ref):
        return e.column
    return e.name if isinstance(e, X.Call) else "<no_name>"


def contains_aggregate(e) -> bool:
    if isinstance(e, X.Call) and e.name in X.AGGREGATES:
        return True
    if isinstance(e, (list, tuple)):
        return any(map(contains_aggregate, e))
    return hasattr(e, "__dataclass_fields__") and any(contains_aggregate(getattr(e, f)) for f in e.__dataclass_fields__)


class Expressions:
    """Turns trees into (Column, kind) over a scope; ``known`` has trees that are columns already (grouped queries)."""

    def __init__(self, scope: Scope, known: dict | None = None):
        self.scope, self.known = scope, known

    def key(self, e):
        """A tree with names resolved, so that equal expressions are equal."""
        if isinstance(e, X.Ref):
            got = self.scope.resolve(e)
            return got if isinstance(got, Field) else self.key(got)
        if isinstance(e, tuple):
            return tuple(map(self.key, e))
        if hasattr(e, "__dataclass_fields__"):
            return replace(e, **{f: self.key(getattr(e, f)) for f in e.__dataclass_fields__ if hasattr(getattr(e, f), "__dataclass_fields__") or isinstance(getattr(e, f), tuple)})
        return e

    def bind(self, e) -> tuple[Column, str]:
        if self.known is not None and not isinstance(e, X.Const):
            got = self.known.get(self.key(e))
            if got:
                return got
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def condition(self, e, what: str) -> Column:
        column, kind = self.bind(e)
        if kind not in ("bool", "null"):
            raise EngineError(f"{what} must be a condition")
        return column.cast("boolean")

    def _const(self, e):
        return literal(e.value, e.kind), e.kind

    def _ref(self, e):
        got = self.scope.resolve(e)
        if not isinstance(got, Field):
            return self.bind(got)
        if self.known is not None:
            raise EngineError(f'column "{e.column}" must appear in GROUP BY or in an aggregate')
        return F.col(got.column), got.kind

    def _field(self, e):
        return F.col(e.column), e.kind

    def _unary(self, e):
        column, kind = self.bind(e.arg)
        if e.op == "not":
            self._want(kind, ("bool",), "NOT")
            return ~column.cast("boolean"), "bool"
        self._want(kind, _NUMBERS, "-")
        return -column, kind

    def _binary(self, e):
        (a, ka), (b, kb) = self.bind(e.left), self.bind(e.right)
        if e.op in ("and", "or"):
            for kind in (ka, kb):
                self._want(kind, ("bool",), e.op.upper())
            a, b = a.cast("boolean"), b.cast("boolean")
            return (a & b if e.op == "and" else a | b), "bool"
        if e.op in ("+", "-", "*", "/"):
            for kind in (ka, kb):
                self._want(kind, _NUMBERS, e.op)
            kind = "double" if "double" in (ka, kb) else "uint" if "uint" in (ka, kb) else "int"
            a, b = a.cast(_SPARK[kind]), b.cast(_SPARK[kind])
            if e.op == "/":
                return (S.divide(a, b) if kind == "double" else S.int_div(a, b, _SPARK[kind])), kind
            return {"+": a + b, "-": a - b, "*": a * b}[e.op], kind
        a, b = self._comparable(a, ka, b, kb)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op], "bool"

    def _comparable(self, a, ka, b, kb):
        if ka in _NUMBERS and kb in _NUMBERS:
            to = "double" if "double" in (ka, kb) else "bigint"
            return a.cast(to), b.cast(to)
        if "null" in (ka, kb):
            to = _SPARK[kb if ka == "null" else ka]
            return (a, b) if to == "void" else (a.cast(to), b.cast(to))
        if ka != kb:
            raise EngineError(f"can't compare {ka} with {kb}")
        return a, b

    def _between(self, e):
        low = X.Binary(">=", e.arg, e.low)
        inside = X.Binary("and", low, X.Binary("<=", e.arg, e.high))
        column, kind = self._binary(inside)
        return (~column if e.negated else column), kind

    def _inlist(self, e):
        out = None
        column, kind = self.bind(e.arg)
        plain = [x.value for x in e.items if isinstance(x, X.Const) and x.kind == kind]
        if len(plain) == len(e.items) > 2 and kind in ("int", "string"):  # one lookup, however long the list
            out = column.isin(plain)
            return (~out if e.negated else out), "bool"
        for item in e.items:
            same, _ = self._binary(X.Binary("=", e.arg, item))
            out = same if out is None else out | same
        return (~out if e.negated else out), "bool"

    def _like(self, e):
        column, kind = self.bind(e.arg)
        self._want(kind, ("string",), "LIKE")
        if isinstance(e.pattern, X.Const) and e.pattern.kind == "string":
            out = S.like(column.cast("string"), e.pattern.value)
        else:
            pattern, kind = self.bind(e.pattern)
            self._want(kind, ("string",), "LIKE")
            escaped = F.replace(pattern.cast("string"), F.lit("\\"), F.lit("\\\\"))
            out = F.call_function("like", column.cast("string"), escaped)
        return (~out if e.negated else out), "bool"

    def _isnull(self, e):
        column, _ = self.bind(e.arg)
        return (column.isNotNull() if e.negated else column.isNull()), "bool"

    def _cast(self, e):
        column, kind = self.bind(e.arg)
        self._want(kind, ("bool", "string"), "CAST")
        return (column if kind == "bool" else S.to_bool(column)), "bool"

    def _call(self, e):
        if e.name in X.AGGREGATES:
            raise EngineError(f"{e.name} is not allowed here")
        column, kind = self.bind(e.args[0])
        self._want(kind, ("string",), e.name)
        column = column.cast("string")
        if e.name == "length":
            return S.byte_length(column), "int"
        return (S.lower if e.name == "lower" else S.upper)(column), "string"

    def _star(self, e):
        raise EngineError("* is not allowed here")

    @staticmethod
    def _want(kind: str, kinds, what: str) -> None:
        if kind != "null" and kind not in kinds:
            raise EngineError(f"{what} can't be applied to {kind}")


def aggregate(call: X.Call, inner: Expressions) -> tuple[Column, str]:
    if not call.args:
        return F.count(F.lit(1)), "uint"
    if contains_aggregate(call.args):
        raise EngineError("aggregates can't be nested")
    column, kind = inner.bind(call.args[0])
    if call.name == "count":
        return (F.count_distinct(column) if call.distinct else F.count(column)), "uint"
    if call.name in ("sum", "avg"):
        Expressions._want(kind, _NUMBERS, call.name)
        column = column.cast("double") if call.name == "avg" or kind == "double" else column
        if call.name == "avg":
            return (F.sum_distinct(column) / F.count_distinct(column) if call.distinct else F.avg(column)), "double"
        return (F.sum_distinct(column) if call.distinct else F.sum(column)), "double" if kind == "double" else "uint"
    return {"min": F.min, "max": F.max}[call.name](column), kind


#: Kinds of Spark's types; columns of any other type can be selected, counted and tested for null.
_FROM_SPARK = {"int": "int", "smallint": "int", "tinyint": "int", "bigint": "uint", "double": "double", "float": "double", "string": "varchar", "boolean": "bool"}


@dataclass
class Bound:
    df: DataFrame
    names: list[str]
    kinds: list[str]
    lock_keys: DataFrame | None = None
    lock_table: str | None = None


class Binder:
    """Binds queries; ``lookup(name)`` gives a table's (rows with keys, columns, statistics or None)."""

    def __init__(self, spark: SparkSession, lookup: Callable, force_join: str = "none", greedy: bool = False):
        self.spark, self.lookup, self.force_join, self.greedy = spark, lookup, force_join, greedy
        self.count = 0

    # -- FROM --

    def table(self, node: X.Table) -> Scope:
        df, columns, _ = self.lookup(node.name)
        names = [f"c{self.count + i}" for i in range(len(columns))]
        self.count += len(columns)
        keyed = all(k in df.columns for k in KEYS)
        keys = (f"s{self.count}", f"r{self.count}") if keyed else None
        renamed = [F.col(c[0]).alias(n) for c, n in zip(columns, names, strict=True)] + ([F.col(k).alias(n) for k, n in zip(KEYS, keys, strict=True)] if keyed else [])
        fields = [Field(node.alias, c, n, KIND_OF[k]) for (c, k, _), n in zip(columns, names, strict=True)]
        return Scope(df.select(*renamed), fields, keys=keys)

    def source(self, node, where=None) -> tuple[Scope, object]:
        """The scope of a FROM clause, and what of WHERE it hasn't used."""
        seen: set[str] = set()

        def names(n):
            if isinstance(n, X.Join):
                names(n.left), names(n.right)
            elif n.alias in seen:
                raise EngineError(f'table name "{n.alias}" specified more than once')
            else:
                seen.add(n.alias)

        names(node)
        ordered = self._greedy(node, where) if self.greedy and len(seen) > 2 else None
        return ordered or (self._joined(node), where)

    def _joined(self, node) -> Scope:
        if isinstance(node, X.Table):
            return self.table(node)
        left, right = self._joined(node.left), self._joined(node.right)
        both = Scope(left.df, left.fields + right.fields)
        if node.how == "cross":
            return Scope(left.df.crossJoin(right.df), both.fields)
        if node.using:
            a, b = left.resolve(X.Ref(None, node.using)), right.resolve(X.Ref(None, node.using))
            condition = Expressions(both).condition(X.Binary("=", a, b), "USING")
            simple = True
        else:
            condition = Expressions(both).condition(node.on, "ON")
            simple = isinstance(node.on, X.Binary) and node.on.op == "=" and isinstance(node.on.left, X.Ref) and isinstance(node.on.right, X.Ref)
        side = hinted(right.df, self.force_join) if simple else right.df
        return Scope(left.df.join(side, condition, node.how), both.fields)

    def _greedy(self, node, where):
        """Inner joins of analysed tables in greedy order, if the clause has only those; else None."""
        tables, parts = [], X.conjuncts(where)

        def flatten(n) -> bool:
            if isinstance(n, X.Table):
                tables.append(n)
                return True
            if n.how not in ("inner", "cross") or n.using:
                return False
            parts.extend(X.conjuncts(n.on))
            return flatten(n.left) and flatten(n.right)

        if not flatten(node):
            return None
        statistics = [self.lookup(t.name)[2] for t in tables]
        if not all(statistics):
            return None
        scopes = {t.alias: self.table(t) for t in tables}
        everything = Scope(None, [f for t in tables for f in scopes[t.alias].fields])
        links = []
        for p in parts:
            if isinstance(p, X.Binary) and p.op == "=" and isinstance(p.left, X.Ref) and isinstance(p.right, X.Ref):
                a, b = everything.resolve(p.left), everything.resolve(p.right)
                if a.table != b.table and a.name == b.name:
                    links.append((a.table, b.table, a.name))
        relations = [Relation(t.alias, scopes[t.alias].df, s["rows"], s["distinct"]) for t, s in zip(tables, statistics, strict=True)]
        order = greedy_order(relations, links)
        left, waiting = scopes[order[0]], list(parts)
        out = Scope(left.df, list(left.fields))
        for alias in order[1:]:
            out.fields = out.fields + scopes[alias].fields
            ready = [p for p in waiting if self._binds(out, p)]
            waiting = [p for p in waiting if p not in ready]
            condition = None
            for p in ready:
                column = Expressions(out).condition(p, "ON")
                condition = column if condition is None else condition & column
            out.df = out.df.crossJoin(scopes[alias].df) if condition is None else out.df.join(scopes[alias].df, condition)
        rest = None
        for p in waiting:
            rest = p if rest is None else X.Binary("and", rest, p)
        return Scope(out.df, everything.fields), rest

    @staticmethod
    def _binds(scope: Scope, e) -> bool:
        try:
            Expressions(scope).bind(e)
            return True
        except EngineError:
            return False

    # -- queries --

    def query(self, node) -> Bound:
        return self.values(node) if isinstance(node, X.Values) else self.select(node)

    def values(self, node: X.Values) -> Bound:
        width = len(node.rows[0])
        if any(len(r) != width for r in node.rows):
            raise EngineError("VALUES rows must have the same number of items")
        empty = Expressions(Scope(None, []))
        bound = [[empty.bind(e) for e in row] for row in node.rows]
        kinds = [self._common([row[i][1] for row in bound]) for i in range(width)]
        rows = [F.struct(*(c.cast(_SPARK[k]).alias(f"v{i}") for i, ((c, _), k) in enumerate(zip(row, kinds, strict=True)))) for row in bound]
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return Bound(df, [f"#{i + 1}" for i in range(width)], kinds)

    @staticmethod
    def _common(kinds: list[str]) -> str:
        kinds = {k for k in kinds if k != "null"}
        if kinds <= {"int", "double"} and len(kinds) == 2:
            return "double"
        if len(kinds) > 1:
            raise EngineError(f"VALUES mixes {' and '.join(sorted(kinds))}")
        return kinds.pop() if kinds else "null"

    @staticmethod
    def _count(e, what: str) -> int | None:
        if e is None:
            return None
        if not (isinstance(e, X.Const) and e.kind == "int"):
            raise EngineError(f"{what} must be an integer")
        if e.value < 0:
            raise EngineError(f"{what} must not be negative")
        return e.value

    def select(self, node: X.Select) -> Bound:
        limit, offset = self._count(node.limit, "LIMIT"), self._count(node.offset, "OFFSET")
        if node.source is None:
            scope, where = Scope(self.spark.range(1).select(F.lit(True).alias("one")), []), node.where
        else:
            scope, where = self.source(node.source, node.where)
        rows = scope.df
        if where is not None:
            rows = rows.where(Expressions(scope).condition(where, "WHERE"))
        items = []
        for e, alias in node.items:
            if isinstance(e, X.Star):
                if node.source is None:
                    raise EngineError("SELECT * needs a FROM clause")
                found = [f for f in scope.fields if e.table in (None, f.table)]
                if not found:
                    raise EngineError(f'no table "{e.table}"')
                items += [(f, None, f.name) for f in found]
            else:
                items.append((e, alias, alias or name_of(e)))
        aliases: dict[str, object] = {}
        for e, alias, _ in items:
            if alias:
                if alias in aliases:
                    raise EngineError(f'alias "{alias}" specified more than once')
                aliases[alias] = e
        named = replace(scope, aliases=aliases)
        grouped = bool(node.group) or node.having is not None or any(contains_aggregate(e) for e, _, _ in items) or any(contains_aggregate(e) for e, _ in node.order)
        if grouped:
            rows, outer_items, outer = self._grouped(rows, scope, named, items, node)
        else:
            outer_items, outer = Expressions(scope), Expressions(named)
        bound = [outer_items.bind(e) for e, _, _ in items]
        sort = [outer.bind(e)[0] for e, _ in node.order]
        names, kinds = [n for _, _, n in items], [k for _, k in bound]
        out = [c.alias(f"o{i}") for i, (c, _) in enumerate(bound)]
        lock = None
        if node.lock:
            if not isinstance(node.source, X.Table) or scope.keys is None or grouped or node.distinct:
                raise EngineError("FOR UPDATE and FOR SHARE need a single table")
            lock = scope.keys
        if node.distinct:
            rows = rows.select(*out).distinct()
            places = [outer.key(e) for e, _, _ in items]
            sort = []
            for e, _ in node.order:
                if outer.key(e) not in places:
                    raise EngineError("ORDER BY of SELECT DISTINCT must be in the select list")
                sort.append(F.col(f"o{places.index(outer.key(e))}"))
        else:
            rows = rows.select(*out, *(c.alias(f"k{i}") for i, c in enumerate(sort)), *(lock or ()))
            sort = [F.col(f"k{i}") for i in range(len(sort))]
        if sort:
            rows = rows.orderBy(*(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last() for c, (_, way) in zip(sort, node.order, strict=True)))
        if offset:
            rows = rows.offset(offset)
        if limit is not None:
            rows = rows.limit(limit)
        keys = rows.select(*(F.col(c).alias(k) for c, k in zip(lock, KEYS, strict=True))) if lock else None
        return Bound(rows.select(*(f"o{i}" for i in range(len(names)))), names, kinds, keys, node.source.name if lock else None)

    def _grouped(self, rows, scope, named, items, node):
        """Rows after grouping and HAVING, and expressions over them without and with aliases."""
        inner, within = Expressions(scope), Expressions(named)
        known: dict = {}
        keys = []
        for i, e in enumerate(node.group):
            if contains_aggregate(e):
                raise EngineError("aggregates are not allowed in GROUP BY")
            column, kind = within.bind(e)
            keys.append(column.alias(f"g{i}"))
            known[within.key(e)] = F.col(f"g{i}"), kind
        calls: list = []

        def collect(e):
            if isinstance(e, X.Call) and e.name in X.AGGREGATES:
                calls.append(e)
            elif isinstance(e, (list, tuple)):
                for x in e:
                    collect(x)
            elif hasattr(e, "__dataclass_fields__"):
                for f in e.__dataclass_fields__:
                    collect(getattr(e, f))

        collect([e for e, _, _ in items])
        collect([node.having] if node.having is not None else [])
        collect([e for e, _ in node.order])
        outs = []
        for call in calls:
            key = within.key(call)
            if key not in known:
                column, kind = aggregate(call, inner)
                known[key] = F.col(f"a{len(outs)}"), kind
                outs.append(column.alias(f"a{len(outs)}"))
        if keys:
            rows = rows.groupBy(*keys).agg(*outs) if outs else rows.select(*keys).distinct()
        else:
            rows = rows.agg(*(outs or [F.count(F.lit(1)).alias("none")]))
        outer_items, outer = Expressions(scope, known), Expressions(named, known)
        if node.having is not None:
            rows = rows.where(outer.condition(node.having, "HAVING"))
        return rows, outer_items, outer


def select_over(tables: dict[str, DataFrame], text: str, force_join: str = "none") -> DataFrame:
    """The rows of a SELECT of the dialect over DataFrames by name; output columns must have different names."""
    (statement,) = X.parse(text)
    if not isinstance(statement, X.Select):
        raise EngineError("only SELECT can be run over DataFrames")
    spark = next(iter(tables.values())).sparkSession

    def lookup(name: str):
        if name not in tables:
            raise EngineError(f'table "{name}" does not exist')
        df = tables[name]
        return df, [(c, _FROM_SPARK.get(kind, "other"), 0) for c, kind in df.dtypes], None

    bound = Binder(spark, lookup, force_join).select(statement)
    return bound.df.toDF(*bound.names)
