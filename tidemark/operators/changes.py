"""From requested changes to versions: normalisation, no-op removal, planned updates and deletes, validation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import assigned
from tidemark.functions.predicates import Predicate, to_filter
from tidemark.functions.values import DELETE, INSERT, UPDATE, mask_of, same_row


class DuplicateKey(ValueError):
    pass


def bad_keys(rows: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that are NULL or given more than once, with n, how often."""
    return rows.groupBy(*pk).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull() for k in pk], F.lit(False)))


def check_keys(rows: DataFrame, pk: list[str]) -> None:
    """Raises on a key that is NULL or given twice."""
    if bad := bad_keys(rows, pk).limit(1).collect():
        raise DuplicateKey(f"key {[bad[0][k] for k in pk]} is null or given more than once")


def normalise(changes: DataFrame, current: DataFrame, pk: list[str], columns: dict[int, str]) -> DataFrame:
    """Changes (columns, op) against current rows: op and changed as they will be stored, no-ops left out.

    A delete of an absent key and a write of an equal row are no-ops. A write is an insert or an update by
    whether the key is live. A tombstone holds its key alone.
    """
    values = [c for c in columns.values() if c not in pk]
    live = current.select(*[F.col(k) for k in pk], *[F.col(v).alias(f"__old_{v}") for v in values], F.lit(True).alias("__live"))
    j = changes.join(live, pk, "left")
    exists = F.col("__live").isNotNull()
    ids = {name: i for i, name in columns.items()}
    before, after = {ids[v]: F.col(f"__old_{v}") for v in values}, {ids[v]: F.col(v) for v in values}
    equal = same_row([F.col(f"__old_{v}") for v in values], [F.col(v) for v in values])
    op = F.when(F.col("op") == DELETE, F.when(exists, DELETE)).when(~exists, INSERT).when(~equal, UPDATE)
    # All columns of an insert or a delete count as changed where they hold a value.
    mask = F.when(F.col("__op") == UPDATE, mask_of(before, after)).when(F.col("__op") == INSERT, mask_of({i: F.lit(None) for i in after}, after)).otherwise(mask_of(before, {i: F.lit(None) for i in before}))
    rows = j.withColumn("__op", op).where(F.col("__op").isNotNull()).withColumn("changed", mask)
    kept = [F.col(c) if c in pk else F.when(F.col("__op") != DELETE, F.col(c)).alias(c) for c in columns.values()]
    return rows.select(F.col("__op").alias("op"), "changed", *kept)


def update_where(rows: DataFrame, where: Predicate | None, assignments: dict[str, Any]) -> DataFrame:
    """Rows that fit, with assignments taken from the old row; rows that stay equal are left out."""
    fit = rows.where(to_filter(where)) if where is not None else rows
    new = {name: assigned(e, rows.schema, name) for name, e in assignments.items()}
    out = fit.select(*fit.columns, *[c.alias(f"__new_{n}") for n, c in new.items()])
    out = out.where(~same_row([F.col(n) for n in new], [F.col(f"__new_{n}") for n in new]))
    return out.select(*[F.col(f"__new_{c}").alias(c) if c in new else F.col(c) for c in rows.columns])


def delete_where(rows: DataFrame, where: Predicate | None, pk: list[str]) -> DataFrame:
    """Keys of the rows that fit."""
    return (rows.where(to_filter(where)) if where is not None else rows).select(*pk)


def unique_violations(rows: DataFrame, columns: list[str], pk: list[str]) -> DataFrame:
    """Values of a unique column list that more than one key holds; a NULL in the list exempts a row.

    Counts first: only keys of values that repeat are gathered.
    """
    held = rows.where(F.least(*[F.col(c).isNotNull() for c in columns], F.lit(True)))
    twice = held.groupBy(*columns).agg(F.count("*").alias("n_rows"), F.min(F.struct(*pk)).alias("first_key")).where("n_rows > 1")
    return twice.select(*columns, "n_rows", "first_key")


def null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows) for each column that must hold a value and does not, in one pass."""
    counts = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_rows")) for c in columns])).alias("x")
    return counts.select(pairs).select("x.column", "x.n_rows").where("n_rows > 0")


def foreign_violations(rows: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows whose columns are all set and name no parent row."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns)]).distinct()
    return rows.where(F.least(*[F.col(c).isNotNull() for c in columns], F.lit(True))).join(keys, columns, "left_anti")
