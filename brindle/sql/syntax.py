"""Tokens, syntax trees and a recursive-descent parser of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from brindle.sql.errors import EngineError

_TOKEN = re.compile(r"""\s+|--[^\n]*|(?P<number>\d+\.\d*|\.\d+|\d+)|(?P<string>'(?:[^']|'')*')|"(?P<quoted>[^"]+)"|(?P<name>[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|[-+*/=<>(),.;])""")
#: Words that end an expression or a table name, and so are no alias.
_RESERVED = set("select from where group having order limit offset for on using join inner left right full outer cross natural and or not in like between is null as by asc desc values set union distinct true false cast set".split())
AGGREGATES = ("count", "sum", "avg", "min", "max")
SCALARS = ("lower", "upper", "length")


@dataclass(frozen=True)
class Const:
    value: object
    kind: str


@dataclass(frozen=True)
class Ref:
    table: str | None
    column: str


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: object
    negated: bool


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool


@dataclass(frozen=True)
class Cast:
    arg: object
    kind: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    how: str
    on: object = None
    using: str | None = None


@dataclass
class Select:
    items: list = field(default_factory=list)  # (expression, alias)
    source: object = None
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    order: list = field(default_factory=list)  # (expression, "asc" | "desc")
    limit: object = None
    offset: object = None
    distinct: bool = False
    lock: str | None = None  # "share" | "update"


@dataclass
class Values:
    rows: list


@dataclass
class Insert:
    table: str
    columns: list | None
    source: object


@dataclass
class Update:
    table: str
    changes: list
    where: object


@dataclass
class Delete:
    table: str
    where: object


@dataclass
class Statement:
    """Anything without rows of its own: what it is and its arguments."""

    verb: str
    args: dict = field(default_factory=dict)


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EngineError(f"unexpected character {text[at]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "number":
            out.append(("double", float(m[kind])) if "." in m[kind] else ("int", int(m[kind])))
        elif kind == "string":
            out.append(("string", m[kind][1:-1].replace("''", "'")))
        elif kind == "quoted":
            out.append(("quoted", m[kind]))
        elif kind == "name":
            out.append(("name", m[kind].lower()))
        elif kind == "op":
            out.append(("op", m[kind]))
    return [*out, ("end", None)]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    # -- tokens --

    @property
    def now(self):
        return self.tokens[self.at]

    def take(self, *words: str) -> bool:
        """Steps over the given words or signs if they come next."""
        here = self.tokens[self.at : self.at + len(words)]
        if len(here) == len(words) and all(k in ("name", "op") and v == w for (k, v), w in zip(here, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise EngineError(f"expected {' '.join(words).upper()}, not {self.now[1]!r}")

    def name(self) -> str:
        kind, value = self.now
        if kind not in ("name", "quoted"):
            raise EngineError(f"expected a name, not {value!r}")
        self.at += 1
        return value

    def listed(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # -- statements --

    def batch(self) -> list:
        out = []
        while self.now[0] != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
            if self.now[0] != "end":
                self.need(";")
        return out

    def statement(self):
        kind, word = self.now
        if kind != "name":
            raise EngineError(f"expected a statement, not {word!r}")
        known = getattr(self, f"_{word}", None) if word in _VERBS else None
        if not known:
            raise EngineError(f"unsupported statement {word}")
        return known()

    def _select(self) -> Select:
        self.need("select")
        out = Select(distinct=self.take("distinct"), items=self.listed(self._item))
        if self.take("from"):
            out.source = self._source()
            while self.take(","):
                out.source = Join(out.source, self._source(), "cross")
        if self.take("where"):
            out.where = self.expression()
        if self.take("group", "by"):
            out.group = self.listed(self.expression)
        if self.take("having"):
            out.having = self.expression()
        if self.take("order", "by"):
            out.order = self.listed(self._sort_key)
        while self.now in (("name", "limit"), ("name", "offset"), ("name", "for")):
            if self.take("limit"):
                out.limit = self.expression()
            elif self.take("offset"):
                out.offset = self.expression()
            else:
                self.need("for")
                out.lock = "update" if self.take("update") else self.need("share") or "share"
        return out

    def _item(self):
        if self.take("*"):
            return Star(), None
        if self.now[0] in ("name", "quoted") and [t[1] for t in self.tokens[self.at + 1 : self.at + 3]] == [".", "*"]:
            table = self.name()
            self.at += 2
            return Star(table), None
        e = self.expression()
        return e, self._alias()

    def _alias(self) -> str | None:
        if self.take("as"):
            return self.name()
        kind, value = self.now
        if kind == "quoted" or kind == "name" and value not in _RESERVED:
            return self.name()
        return None

    def _sort_key(self):
        e = self.expression()
        way = "desc" if self.take("desc") else "asc"
        self.take("asc")
        return e, way

    def _source(self):
        left = self._table()
        while True:
            if self.take("cross", "join"):
                left = Join(left, self._table(), "cross")
                continue
            how = None
            for word in ("inner", "left", "right", "full"):
                if self.take(word):
                    how = word
                    self.take("outer")
                    self.need("join")
            if how is None and self.take("join"):
                how = "inner"
            if how is None:
                return left
            right = self._table()
            if self.take("on"):
                left = Join(left, right, how, on=self.expression())
            elif self.take("using"):
                self.need("(")
                left = Join(left, right, how, using=self.name())
                self.need(")")
            else:
                raise EngineError("join condition is not specified")

    def _table(self):
        if self.take("("):
            inner = self._source()
            self.need(")")
            return inner
        name = self.name()
        return Table(name, self._alias() or name)

    def _values(self) -> Values:
        self.need("values")
        return Values(self.listed(self._row))

    def _row(self) -> list:
        self.need("(")
        out = self.listed(self.expression)
        self.need(")")
        return out

    def _insert(self) -> Insert:
        self.need("insert", "into")
        table, columns = self.name(), None
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        return Insert(table, columns, self._values() if self.now == ("name", "values") else self._select())

    def _update(self) -> Update:
        self.need("update")
        table = self.name()
        self.need("set")
        return Update(table, self.listed(self._change), self.expression() if self.take("where") else None)

    def _change(self):
        column = self.name()
        self.need("=")
        return column, self.expression()

    def _delete(self) -> Delete:
        self.need("delete", "from")
        return Delete(self.name(), self.expression() if self.take("where") else None)

    def _create(self) -> Statement:
        self.need("create")
        if self.take("database"):
            return Statement("create database", {"name": self.name()})
        if self.take("index"):
            return self._rest("create index")
        self.need("table")
        name = self.name()
        self.need("(")
        columns = self.listed(self._column)
        self.need(")")
        return Statement("create table", {"name": name, "columns": columns})

    def _column(self):
        name, kind = self.name(), self.name()
        kind = {"integer": "int", "int4": "int", "float8": "double", "character": "char"}.get(kind, kind)
        if kind == "double":
            self.take("precision")
        length = None
        if self.take("("):
            if self.now[0] != "int":
                raise EngineError("expected a length")
            length = self.now[1]
            self.at += 1
            self.need(")")
        if kind not in ("int", "double", "char", "varchar"):
            raise EngineError(f"unknown column type {kind}")
        if kind == "varchar" and length is None:
            raise EngineError("varchar needs a length")
        return name, kind, {"int": 4, "double": 8}.get(kind, length or 1)

    def _drop(self) -> Statement:
        self.need("drop")
        for what in ("table", "database", "index"):
            if self.take(what):
                exists = self.take("if", "exists")
                return Statement(f"drop {what}", {"names": self.listed(self.name), "if_exists": exists})
        raise EngineError("unsupported DROP")

    def _begin(self) -> Statement:
        self.at += 1
        self.take("transaction")
        return Statement("begin")

    _start = _begin

    def _commit(self) -> Statement:
        self.at += 1
        return Statement("commit")

    def _rollback(self) -> Statement:
        self.at += 1
        return Statement("rollback")

    def _lock(self) -> Statement:
        self.at += 1
        self.take("table")
        name = self.name()
        self.need("in")
        mode = "S" if self.take("share") else self.need("exclusive") or "X"
        self.need("mode")
        return Statement("lock", {"table": name, "mode": mode})

    def _set(self) -> Statement:
        self.at += 1
        name = self.name()
        if not self.take("="):
            self.need("to")
        kind, value = self.now
        sign = "-" if self.take("-") else ""
        kind, value = self.now
        if kind in ("end", "op"):
            raise EngineError("SET needs a value")
        self.at += 1
        return Statement("set", {"name": name, "value": f"{sign}{value:g}" if kind == "double" else f"{sign}{value}"})

    def _show(self) -> Statement:
        self.at += 1
        return Statement("show", {"name": self.name()})

    def _explain(self) -> Statement:
        self.at += 1
        stages = []
        if self.take("("):
            stages = self.listed(self.name)
            self.need(")")
            if set(stages) - {"binder", "planner", "optimizer"}:
                raise EngineError("EXPLAIN shows binder, planner or optimizer")
        return Statement("explain", {"stages": stages or ["binder", "planner", "optimizer"], "statement": self.statement()})

    def _analyze(self) -> Statement:
        self.at += 1
        out = {"table": None, "columns": None}
        if self.now[0] in ("name", "quoted"):
            out["table"] = self.name()
            if self.take("("):
                out["columns"] = self.listed(self.name)
                self.need(")")
        return Statement("analyze", out)

    def _vacuum(self) -> Statement:
        self.at += 1
        return Statement("vacuum", {"table": self.name() if self.now[0] in ("name", "quoted") else None})

    def _checkpoint(self) -> Statement:
        self.at += 1
        return Statement("checkpoint")

    def _rest(self, verb: str) -> Statement:
        while self.now[0] != "end" and self.now != ("op", ";"):
            self.at += 1
        return Statement(verb)

    # -- expressions, loosest first --

    def expression(self):
        left = self._and()
        while self.take("or"):
            left = Binary("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self.take("and"):
            left = Binary("and", left, self._not())
        return left

    def _not(self):
        return Unary("not", self._not()) if self.take("not") else self._predicate()

    def _predicate(self):
        left = self._sum()
        while True:
            kind, value = self.now
            if kind == "op" and value in ("=", "!=", "<>", "<", "<=", ">", ">="):
                self.at += 1
                left = Binary("<>" if value == "!=" else value, left, self._sum())
                continue
            if self.take("is"):
                negated = self.take("not")
                self.need("null")
                left = IsNull(left, negated)
                continue
            mark = self.at
            negated = self.take("not")
            if self.take("between"):
                low = self._sum()
                self.need("and")
                left = Between(left, low, self._sum(), negated)
            elif self.take("in"):
                left = InList(left, tuple(self._row()), negated)
            elif self.take("like"):
                left = Like(left, self._sum(), negated)
            else:
                self.at = mark
                return left

    def _sum(self):
        left = self._product()
        while self.now in (("op", "+"), ("op", "-")):
            op = self.now[1]
            self.at += 1
            left = Binary(op, left, self._product())
        return left

    def _product(self):
        left = self._unary()
        while self.now in (("op", "*"), ("op", "/")):
            op = self.now[1]
            self.at += 1
            left = Binary(op, left, self._unary())
        return left

    def _unary(self):
        if self.take("-"):
            arg = self._unary()
            return Const(-arg.value, arg.kind) if isinstance(arg, Const) and arg.kind in ("int", "double") else Unary("-", arg)
        if self.take("+"):
            return self._unary()
        return self._primary()

    def _primary(self):
        kind, value = self.now
        if kind in ("int", "double", "string"):
            self.at += 1
            return Const(value, kind)
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        for word, const in (("null", Const(None, "null")), ("true", Const(True, "bool")), ("false", Const(False, "bool"))):
            if self.take(word):
                return const
        if self.take("cast"):
            self.need("(")
            inner = self.expression()
            self.need("as")
            to = self.name()
            self.need(")")
            if to not in ("bool", "boolean"):
                raise EngineError(f"unsupported cast to {to}")
            return Cast(inner, "bool")
        name = self.name()
        if self.take("."):
            return Ref(name, self.name())
        if self.take("("):
            if name not in AGGREGATES + SCALARS:
                raise EngineError(f"unsupported function {name}")
            if self.take("*"):
                self.need(")")
                if name != "count":
                    raise EngineError(f"{name}(*) is not supported")
                return Call(name, ())
            distinct = self.take("distinct")
            if distinct and name in SCALARS:
                raise EngineError(f"DISTINCT is not supported in {name}")
            args = tuple(self.listed(self.expression)) if self.now != ("op", ")") else ()
            self.need(")")
            if len(args) != 1:
                raise EngineError(f"{name} takes one argument")
            return Call(name, args, distinct)
        return Ref(None, name)


_VERBS = "select values insert update delete create drop begin start commit rollback lock set show explain analyze vacuum checkpoint".split()


def parse(text: str) -> list:
    """The statements of a text, parted by semicolons."""
    return Parser(text).batch()


def conjuncts(e) -> list:
    return [] if e is None else conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "and" else [e]
