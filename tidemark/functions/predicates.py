"""The closed predicate grammar. Filters follow SQL's three-valued logic, CASE arms a two-valued one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return Or([self, other])

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    op: str  # eq ne lt le gt ge
    column: str
    value: Any


@dataclass(frozen=True)
class Like(Predicate):
    column: str
    pattern: str


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str


@dataclass(frozen=True)
class And(Predicate):
    parts: list = field(default_factory=list)


@dataclass(frozen=True)
class Or(Predicate):
    parts: list = field(default_factory=list)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


class Col:
    """Builder: Col("price") >= 5, Col("name").like("a%")."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, value):  # type: ignore[override]
        return Compare("eq", self.name, value)

    def __ne__(self, value):  # type: ignore[override]
        return Compare("ne", self.name, value)

    def __lt__(self, value):
        return Compare("lt", self.name, value)

    def __le__(self, value):
        return Compare("le", self.name, value)

    def __gt__(self, value):
        return Compare("gt", self.name, value)

    def __ge__(self, value):
        return Compare("ge", self.name, value)

    __hash__ = None  # type: ignore[assignment]

    def like(self, pattern: str) -> Like:
        return Like(self.name, pattern)

    def isin(self, *values) -> In:
        return In(self.name, tuple(values))

    def is_null(self) -> IsNull:
        return IsNull(self.name)


_PLAIN = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def columns_of(p: Predicate) -> set[str]:
    if isinstance(p, (And, Or)):
        return set().union(*map(columns_of, p.parts)) if p.parts else set()
    return columns_of(p.part) if isinstance(p, Not) else {p.column}


def to_filter(p: Predicate) -> Column:
    """Three-valued: a NULL operand makes a comparison NULL, and the row is not returned."""
    if isinstance(p, Compare):
        return _PLAIN[p.op](F.col(p.column), F.lit(p.value))
    if isinstance(p, Like):
        return F.col(p.column).like(p.pattern)
    if isinstance(p, In):
        return F.col(p.column).isin(*p.values) if p.values else F.lit(False)
    if isinstance(p, IsNull):
        return F.col(p.column).isNull()
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, map(to_filter, p.parts), F.lit(True))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, map(to_filter, p.parts), F.lit(False))
    if isinstance(p, Not):
        return ~to_filter(p.part)
    raise TypeError(f"not a predicate: {p!r}")


def to_case(p: Predicate) -> Column:
    """Two-valued: equality is null-safe, and a NULL operand counts as equal in an order comparison."""
    if isinstance(p, Compare):
        a, b = F.col(p.column), F.lit(p.value)
        if p.op == "eq":
            return a.eqNullSafe(b)
        if p.op == "ne":
            return ~a.eqNullSafe(b)
        return F.coalesce(_PLAIN[p.op](a, b), F.lit(p.op in ("le", "ge")))
    if isinstance(p, Like):
        raise TypeError("LIKE has no two-valued form")
    if isinstance(p, In):
        return reduce(lambda x, v: x | F.col(p.column).eqNullSafe(F.lit(v)), p.values, F.lit(False))
    if isinstance(p, IsNull):
        return F.col(p.column).isNull()
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, map(to_case, p.parts), F.lit(True))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, map(to_case, p.parts), F.lit(False))
    if isinstance(p, Not):
        return ~to_case(p.part)
    raise TypeError(f"not a predicate: {p!r}")


def key_predicate(pk: dict[str, Any]) -> Predicate:
    return And([Compare("eq", k, v) for k, v in pk.items()])


def after_key(order: list[str], last: dict[str, Any]) -> Column:
    """Rows behind a key in key order, for keyset paging over any number of key columns."""
    out, equal = F.lit(False), F.lit(True)
    for name in order:
        out = out | (equal & (F.col(name) > F.lit(last[name])))
        equal = equal & (F.col(name) == F.lit(last[name]))
    return out
