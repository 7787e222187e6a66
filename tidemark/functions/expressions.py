"""Assignment expressions: constants, columns, exact arithmetic, concat, coalesce, case."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.predicates import Predicate, to_case
from tidemark.functions.values import FLOAT, INT, NULL, NUMERIC, TEXT, display, kind_of

#: Long quotients and products are rounded to this many places.
PLACES = 12


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Ref:
    column: str


@dataclass(frozen=True)
class Arith:
    op: str  # + - * /
    left: Any
    right: Any


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Coalesce:
    parts: tuple


@dataclass(frozen=True)
class Case:
    arms: tuple  # of (predicate, expression)
    otherwise: Any = None


@dataclass(frozen=True)
class _Typed:
    column: Column
    type: T.DataType


def _const(value: Any) -> _Typed:
    if value is None:
        return _Typed(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return _Typed(F.lit(value), T.BooleanType())
    if isinstance(value, int):
        return _Typed(F.lit(value).cast("long"), T.LongType())
    if isinstance(value, float):
        return _exact(_Typed(F.lit(value), T.DoubleType()))
    if isinstance(value, Decimal):
        scale = max(0, -int(value.as_tuple().exponent))
        kind = T.DecimalType(max(len(value.as_tuple().digits), scale + 1), scale)
        return _Typed(F.lit(str(value)).cast(kind), kind)
    if isinstance(value, (bytes, bytearray)):
        return _Typed(F.lit(value), T.BinaryType())
    if isinstance(value, str):
        return _Typed(F.lit(value), T.StringType())
    return _Typed(F.lit(value), T.TimestampType())


def _exact(x: _Typed) -> _Typed:
    """Numbers as decimals; a double by its shortest text, so 1.1 is 1.1."""
    if isinstance(x.type, T.DecimalType):
        return x
    kind = T.DecimalType(38, PLACES) if kind_of(x.type) == FLOAT else T.DecimalType(19, 0)
    source = x.column.cast("string") if kind_of(x.type) == FLOAT else x.column
    return _Typed(source.cast(kind), kind)


def _arith(op: str, left: _Typed, right: _Typed) -> _Typed:
    if NULL in (kind_of(left.type), kind_of(right.type)) or isinstance(left.type, T.NullType) or isinstance(right.type, T.NullType):
        return _Typed(F.lit(None), T.NullType())
    if kind_of(left.type) not in (INT, FLOAT, NUMERIC) or kind_of(right.type) not in (INT, FLOAT, NUMERIC):
        raise TypeError(f"{op} needs numbers")
    if kind_of(left.type) == kind_of(right.type) == INT:
        a, b = left.column.cast("long"), right.column.cast("long")
        # Integers keep 64 bits; overflow raises, a quotient is cut toward zero, division by zero is NULL.
        return _Typed({"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, F.call_function("div", a, b))}[op], T.LongType())
    a, b = _exact(left), _exact(right)
    if op == "/":
        # Twelve places need room: digits before the point are limited, and too large a number raises.
        wide, scale = T.DecimalType(38, PLACES), min(b.type.scale, PLACES)
        top = a.column.cast(T.DecimalType(min(a.type.precision - a.type.scale, 26 - scale) + min(a.type.scale, PLACES), min(a.type.scale, PLACES)))
        low = b.column.cast(T.DecimalType(min(b.type.precision, 26), scale))
        return _Typed(F.round(F.when(b.column != 0, top / low), PLACES).cast(wide), wide)
    p, s, q, r = a.type.precision, a.type.scale, b.type.precision, b.type.scale
    if op == "*":
        scale = min(s + r, PLACES)
        if p + q + 1 > 38:  # narrow the wide operand so that the product keeps its places
            a, b = _Typed(a.column.cast(T.DecimalType(min(p, 25), s)), a.type), b
        kind = T.DecimalType(min(38, p + q + 1), scale)
        return _Typed(F.round(a.column * b.column, scale).cast(kind), kind)
    scale = max(s, r)
    kind = T.DecimalType(min(38, max(p - s, q - r) + scale + 1), scale)
    return _Typed((a.column + b.column if op == "+" else a.column - b.column).cast(kind), kind)


def compile_expression(e: Any, schema: T.StructType) -> _Typed:
    """The column an expression makes over a row of schema."""
    if isinstance(e, Const):
        return _const(e.value)
    if isinstance(e, Ref):
        return _Typed(F.col(e.column), schema[e.column].dataType)
    if isinstance(e, Arith):
        return _arith(e.op, compile_expression(e.left, schema), compile_expression(e.right, schema))
    if isinstance(e, Concat):
        parts = [compile_expression(p, schema) for p in e.parts]
        return _Typed(F.concat(*[p.column if kind_of(p.type) == TEXT else display(p.column, p.type) for p in parts]), T.StringType())
    if isinstance(e, Coalesce):
        parts = [compile_expression(p, schema) for p in e.parts]
        kinds = [p.type for p in parts if not isinstance(p.type, T.NullType)]
        return _Typed(F.coalesce(*[p.column for p in parts]), kinds[0] if kinds else T.NullType())
    if isinstance(e, Case):
        out, kinds = None, []
        for when, then in e.arms:
            assert isinstance(when, Predicate)
            value = compile_expression(then, schema)
            kinds.append(value.type)
            out = F.when(to_case(when), value.column) if out is None else out.when(to_case(when), value.column)
        last = compile_expression(e.otherwise if e.otherwise is not None else Const(None), schema)
        kinds.append(last.type)
        known = [k for k in kinds if not isinstance(k, T.NullType)]
        return _Typed(out.otherwise(last.column), known[0] if known else T.NullType())
    return _const(e)


def assigned(e: Any, schema: T.StructType, target: str) -> Column:
    """The expression's value in the type of the column it goes to, rounded to that column's scale."""
    value, kind = compile_expression(e, schema), schema[target].dataType
    if isinstance(kind, T.DecimalType) and isinstance(value.type, T.DecimalType):
        return F.round(value.column, kind.scale).cast(kind)
    return value.column.cast(kind)
