"""What is asked of one table: columns, one predicate, DISTINCT, order and a window; and the rules that a request must keep.

Strict requests hold one equality, inequality or set of equalities over one
KEY or INDEX column. Further predicates (ranges, LIKE, BETWEEN, AND, OR) are
an extension that ``strict=False`` allows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn, functions as F

from ..errors import InvalidArgument, Unimplemented
from .schema import Kind, Role, TableSchema

DEFAULT_LIMIT, MOST_OPERANDS = 10, 64


@dataclass(frozen=True)
class Match:
    """``column op values``; op is one of =, <>, in, <, <=, >, >=, like, between."""

    column: str
    op: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Both:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Any, ...]


def eq(column: str, value: Any) -> Match:
    return Match(column, "=", (value,))


def ne(column: str, value: Any) -> Match:
    return Match(column, "<>", (value,))


def one_of(column: str, *values: Any) -> Match:
    return Match(column, "in", values)


def compare(column: str, op: str, *values: Any) -> Match:
    return Match(column, op, values)


def either(*parts: Any) -> Any:
    """OR; equalities over one column become one set of values."""
    if all(isinstance(p, Match) and p.op in ("=", "in") for p in parts) and len({p.column for p in parts}) == 1:
        return one_of(parts[0].column, *dict.fromkeys(v for p in parts for v in p.values))
    return Either(parts)


def both(*parts: Any) -> Both:
    return Both(parts)


@dataclass(frozen=True)
class Lookup:
    columns: tuple[str | tuple[str, str], ...] = ("*",)
    where: Any = None
    distinct: bool = False
    order_by: tuple[str | tuple[str, str], ...] = ()
    limit: int | None = DEFAULT_LIMIT  # None: all
    offset: int = 0

    def projected(self, schema: TableSchema) -> list[tuple[str, str]]:
        """(source, shown name) of each column; ``*`` is all but the KEY."""
        out = []
        for c in self.columns:
            out += [(n, n) for n in schema.returned] if c == "*" else [(c, c) if isinstance(c, str) else c]
        return out

    def orders(self) -> list[tuple[str, bool]]:
        return [(o, False) if isinstance(o, str) else (o[0], o[1].lower() == "desc") for o in self.order_by]


def check_window(lookup: Lookup) -> None:
    if lookup.limit is not None and (not isinstance(lookup.limit, int) or lookup.limit < 1):
        raise InvalidArgument("LIMIT is at least 1")
    if not isinstance(lookup.offset, int) or lookup.offset < 0:
        raise InvalidArgument("OFFSET is at least 0")


def check(lookup: Lookup, schema: TableSchema, strict: bool = True) -> None:
    check_window(lookup)
    names = [source for source, _ in lookup.projected(schema)]
    for name in [*names, *(n for n, _ in lookup.orders())]:
        if schema.column(name).role is Role.KEY:
            raise Unimplemented(f"the KEY {name} can't be returned or ordered by")
    if lookup.where is not None:
        if len(set(names)) < len(names):
            raise InvalidArgument("a column is asked for twice")
        check_where(lookup.where, schema, strict)


def check_where(where: Any, schema: TableSchema, strict: bool = True) -> None:
    if isinstance(where, (Both, Either)):
        if strict:
            raise Unimplemented("AND, and OR over several columns, are extensions")
        for part in where.parts:
            check_where(part, schema, strict)
        return
    column = schema.column(where.column)
    if strict:
        if where.op not in ("=", "<>", "in"):
            raise Unimplemented(f"{where.op} is an extension")
        if not column.searchable:
            raise InvalidArgument(f"{column.name} is neither KEY nor INDEX")
    if not where.values or len(set(where.values)) > MOST_OPERANDS:
        raise InvalidArgument(f"1 to {MOST_OPERANDS} values")
    if where.op in ("=", "<>", "<", "<=", ">", ">=", "like") and len(where.values) != 1 or where.op == "between" and len(where.values) != 2:
        raise InvalidArgument(f"{where.op} has a wrong number of values")
    wanted = {Kind.INT: int, Kind.REAL: (int, float), Kind.TEXT: str, Kind.JSON: str}.get(column.kind)
    if wanted and not all(isinstance(v, wanted) and not isinstance(v, bool) for v in where.values):
        raise InvalidArgument(f"{column.name} is {column.kind.value}")


def predicate(where: Any) -> SparkColumn:
    """The predicate as a Column that Spark can push down."""
    if isinstance(where, Both):
        return reduce(lambda a, b: a & b, map(predicate, where.parts))
    if isinstance(where, Either):
        return reduce(lambda a, b: a | b, map(predicate, where.parts))
    c, v = F.col(where.column), where.values
    ops = {"=": lambda: c == v[0], "<>": lambda: c != v[0], "in": lambda: c.isin(*v), "<": lambda: c < v[0], "<=": lambda: c <= v[0], ">": lambda: c > v[0], ">=": lambda: c >= v[0], "like": lambda: c.like(v[0]), "between": lambda: c.between(*v)}
    if where.op not in ops:
        raise InvalidArgument(f"no operator {where.op!r}")
    return ops[where.op]()
