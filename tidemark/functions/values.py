"""The eight value kinds, their Spark types, canonical decimals and column differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOL, INT, FLOAT, NUMERIC, TEXT, BYTES, TIME = range(8)
#: Open intervals end here; never add to it, ANSI mode raises.
MAX_SEQ = 9223372036854775807
INSERT, UPDATE, DELETE = 1, 2, 3


class UnsupportedType(ValueError):
    pass


def kind_of(data_type: T.DataType) -> int | None:
    """The kind a Spark type maps to; None where versioned tracking refuses it."""
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(data_type, T.DecimalType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.BinaryType):
        return BYTES
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    return None


def normalize_decimal(text: str) -> str:
    """Canonical decimal text: no sign on zero, no leading or trailing zeros."""
    m = re.fullmatch(r"([+-]?)(\d*)(?:\.(\d*))?", text.strip())
    if not m or not (m[2] or m[3]):
        raise ValueError(f"not a decimal: {text!r}")
    whole, rest = m[2].lstrip("0") or "0", (m[3] or "").rstrip("0")
    body = f"{whole}.{rest}" if rest else whole
    return f"-{body}" if m[1] == "-" and body != "0" else body


def decimal_text(value: Column) -> Column:
    """Canonical text of a decimal column; zeros are cut only behind a point."""
    text = value.cast("string")
    # A scale beyond six makes Spark print small values with an exponent; format through a plain cast first.
    plain = F.when(text.contains("E"), F.format_string("%s", value.cast("decimal(38,18)").cast("string"))).otherwise(text)
    trimmed = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "\\.$", "")).otherwise(plain)
    return F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed)


def display(value: Column, data_type: T.DataType) -> Column:
    """Text of any value, as concatenation and exports print it."""
    kind = kind_of(data_type)
    if kind == NUMERIC:
        return decimal_text(value)
    if kind == BYTES:
        return F.lower(F.hex(value))
    if kind == TIME and not isinstance(data_type, T.DateType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return value.cast("string")


def mask_of(before: dict[int, Column], after: dict[int, Column]) -> Column:
    """Ids of the columns whose values differ, NULL equal to NULL."""
    return F.array_compact(F.array(*[F.when(~before[i].eqNullSafe(after[i]), F.lit(i)) for i in sorted(before)])).cast("array<int>")


def mask_or(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(left, right))


def mask_union(masks: Column) -> Column:
    """All ids of the masks of a group, an aggregate; each different mask is kept once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(masks))))


def mask_intersects(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)


def same_row(left: list[Column], right: list[Column]) -> Column:
    """All values equal, NULL equal to NULL."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out
