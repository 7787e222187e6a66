"""History, blame, diffs and reverts over a version log, for any number of keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.values import DELETE, INSERT, UPDATE, mask_of, same_row
from tidemark.plans.resolve import Chain, resolve, segment_filter


def history(log: DataFrame, commits: DataFrame, chain: Chain, pk: list[str], inherited: bool = False) -> DataFrame:
    """Versions of each key with author, time and message. The branch's own, or all that its chain shows."""
    seen = segment_filter(chain if inherited else chain[:1]) & F.col("session_id").isNull()
    notes = commits.select("branch_id", F.col("seq").alias("seq_from"), "commit_id", "author", "committed_at", "message")
    return log.where(seen).drop("session_id").join(notes, ["branch_id", "seq_from"], "left")


def blame(versions: DataFrame, pk: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Per key and column: the oldest version of the newest run of equal values; a delete ends a run.

    versions hold pk, columns, op and what order sorts by (seq_from); a key whose newest version is a delete
    is attributed to that delete.
    """
    order = order or ["seq_from"]
    newest = [F.col(c).desc() for c in order]
    by_key = W.partitionBy(*pk)
    down = by_key.orderBy(*newest)
    pieces = []
    marked = versions
    for c in columns:
        # A version breaks the run when its value differs from the next newer one, or it is a delete (but the newest).
        step = F.row_number().over(down) > 1
        differs = ~F.lag(F.col(c)).over(down).eqNullSafe(F.col(c)) | (F.col("op") == DELETE) | (F.lag("op").over(down) == DELETE)
        marked = marked.withColumn(f"__b_{c}", F.when(step, F.coalesce(differs, F.lit(True)).cast("int")).otherwise(0))
    for c in columns:
        marked = marked.withColumn(f"__s_{c}", F.sum(f"__b_{c}").over(down.rowsBetween(W.unboundedPreceding, 0)))
    for c in columns:
        pieces.append(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(f"__s_{c}").alias("run")))
    long = marked.select(*pk, *order, F.explode(F.array(*pieces)).alias("x")).where("x.run = 0")
    first = F.min(F.struct(*order, F.col("x.value").alias("value")))
    return long.groupBy(*pk, F.col("x.column").alias("column")).agg(first.alias("f")).select(*pk, "column", *[F.col(f"f.{o}").alias(o) for o in order], F.col("f.value").alias("value"))


def compare(before: DataFrame, after: DataFrame, pk: list[str], columns: dict[int, str]) -> DataFrame:
    """Net changes between two states: op, changed, old_ and new_ values; equal rows left out."""
    values = {i: c for i, c in columns.items() if c not in pk}
    b = before.select(*pk, *[F.col(c).alias(f"old_{c}") for c in values.values()], F.lit(True).alias("__b"))
    a = after.select(*pk, *[F.col(c).alias(f"new_{c}") for c in values.values()], F.lit(True).alias("__a"))
    j = b.join(a, pk, "full_outer")
    old, new = {i: F.col(f"old_{c}") for i, c in values.items()}, {i: F.col(f"new_{c}") for i, c in values.items()}
    op = F.when(F.col("__b").isNull(), INSERT).when(F.col("__a").isNull(), DELETE).when(~same_row(list(old.values()), list(new.values())), UPDATE)
    return j.withColumn("op", op).where(F.col("op").isNotNull()).select(*pk, "op", mask_of(old, new).alias("changed"), *[x for c in values.values() for x in (f"old_{c}", f"new_{c}")])


def diff(log: DataFrame, chain: Chain, from_seq: int, to_seq: int, pk: list[str], columns: dict[int, str]) -> DataFrame:
    """Net changes of the chain's own branch in (from_seq, to_seq]: only keys with a version there are resolved."""
    branch = chain[0][0]
    rest = chain[1:]
    touched = log.where((F.col("branch_id") == branch) & (F.col("seq_from") > from_seq) & (F.col("seq_from") <= to_seq) & F.col("session_id").isNull()).select(*pk).distinct()
    few = log.where(segment_filter([(branch, to_seq), *rest])).join(touched, pk, "left_semi").select(*log.columns)
    return compare(resolve(few, [(branch, from_seq), *rest], pk), resolve(few, [(branch, to_seq), *rest], pk), pk, columns)


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def inverse(changes: DataFrame, pk: list[str], columns: dict[int, str]) -> DataFrame:
    """The changes that undo changes: op and full rows."""
    values = [c for c in columns.values() if c not in pk]
    op = F.when(F.col("op") == INSERT, DELETE).when(F.col("op") == DELETE, INSERT).otherwise(UPDATE)
    return changes.select(*pk, op.alias("op"), *[F.col(f"old_{v}").alias(v) for v in values])


def touched_later(log: DataFrame, branch: str, seq: int, keys: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that the branch changed after seq."""
    later = log.where((F.col("branch_id") == branch) & (F.col("seq_from") > seq) & F.col("session_id").isNull())
    return keys.select(*pk).join(later, pk, "left_semi")
