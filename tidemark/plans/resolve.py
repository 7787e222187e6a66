"""Resolution: the state of a table on a chain of segments, as one scan and one shuffle.

A version log is append-only: branch_id, seq_from, op, session_id (null once committed) and the row image.
A chain is a list of (branch_id, seq), nearest first. Of a key's versions within the chain the winner is the
one of the nearest segment, newest first; a winner that is a tombstone hides the key. Only key predicates may
go below that choice. Catalyst moves those there by itself, and keeps the others above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.predicates import Predicate, after_key, to_filter
from tidemark.functions.values import DELETE, MAX_SEQ

META = ("branch_id", "seq_from", "op", "session_id")
MAX_DEPTH = 8

Chain = list[tuple[str, int]]


def child_chain(branch_id: str, parent_id: str, parent_head: int, parent_chain: Chain) -> Chain:
    """The chain of a new branch, fixed when it forks."""
    chain = [(branch_id, 0), (parent_id, parent_head), *parent_chain[1:]]
    if len(chain) > MAX_DEPTH:
        raise ValueError(f"chain would be {len(chain)} deep; the most is {MAX_DEPTH}")
    return chain


def segment_filter(chain: Chain) -> Column:
    """Versions within any segment, as literals, so that they prune partitions and reach the scan."""
    return reduce(lambda a, b: a | b, [(F.col("branch_id") == b) & (F.col("seq_from") <= s) for b, s in chain], F.lit(False))


def priority(chain: Chain) -> Column:
    out = None
    for i, (b, _) in enumerate(chain):
        out = F.when(F.col("branch_id") == b, i) if out is None else out.when(F.col("branch_id") == b, i)
    return out if out is not None else F.lit(0)


def winners(log: DataFrame, chain: Chain, pk: list[str], session: str | None = None) -> DataFrame:
    """One version per key, tombstones included."""
    inside = segment_filter(chain) & F.col("session_id").isNull()
    prio = priority(chain)
    if session is not None:
        inside = inside | (F.col("session_id") == session)
        prio = F.when(F.col("session_id").isNotNull(), -1).otherwise(prio)
    # A session stages a key more than once; the latest staging, by its order, wins.
    latest = W.partitionBy(*pk).orderBy(F.col("__prio"), F.col("seq_from").desc())
    return log.where(inside).withColumn("__prio", prio).withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn")


def resolve(log: DataFrame, chain: Chain, pk: list[str], session: str | None = None, where: Predicate | None = None, after: dict | None = None, limit: int | None = None, meta: bool = False) -> DataFrame:
    """The live rows on a chain. where, after (a key) and limit apply to resolved rows; limit is in key order."""
    out = winners(log, chain, pk, session).where(F.col("op") != DELETE)
    out = out.drop("__prio") if meta else out.drop("__prio", *META)
    if where is not None:
        out = out.where(to_filter(where))
    if after is not None:
        out = out.where(after_key(pk, after))
    if limit is not None:
        out = out.orderBy(*pk).limit(limit)
    return out


def candidate_keys(log: DataFrame, chain: Chain, pk: list[str]) -> DataFrame:
    """Keys with any version within the chain."""
    return log.where(segment_filter(chain) & F.col("session_id").isNull()).select(*pk).distinct()


def beyond(chain: Chain, base: Chain) -> Column:
    """Committed versions that one of both chains shows and the other does not, as ranges that reach the scan."""
    top = [{b: max(s for x, s in c if x == b) for b, _ in c} for c in (chain, base)]
    out = F.lit(False)
    for b in sorted({*top[0], *top[1]}):
        low, high = sorted(t.get(b, -1) for t in top)
        if low < high:
            out = out | ((F.col("branch_id") == b) & (F.col("seq_from") > low) & (F.col("seq_from") <= high))
    return out & F.col("session_id").isNull()


def candidate_resolve(log: DataFrame, chain: Chain, pk: list[str], where: Predicate) -> DataFrame:
    """The two-pass form: keys with any version that fits, then those keys resolved and filtered again.

    Worth it where files can be skipped on the predicate; always the same rows as resolve.
    """
    keys = candidate_keys(log.where(to_filter(where)), chain, pk)
    return resolve(log.join(keys, pk, "left_semi").select(*log.columns), chain, pk, where=where)


def intervals(log: DataFrame, pk: list[str]) -> DataFrame:
    """The log with seq_to: where the key's next version on the same branch begins, or MAX_SEQ."""
    nxt = F.lead("seq_from", 1, MAX_SEQ).over(W.partitionBy("branch_id", *pk).orderBy("seq_from"))
    return log.where(F.col("session_id").isNull()).withColumn("seq_to", nxt)


def as_of(commits: DataFrame, moments: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """For each moment (branch_id, moment): the greatest seq of its branch's commits (branch_id, moment, seq) up to it.

    A moment is a number, such as microseconds. Windows run within spans of width, so no task holds a branch whole;
    what came before a span is one number, from a table of a row per span.
    """
    span = F.floor(F.col("moment") / width).alias("span")
    c = commits.select("branch_id", "moment", "seq", span)
    m = moments.select("branch_id", "moment", F.lit(None).cast("long").alias("seq"), span).distinct()
    both = c.withColumn("asked", F.lit(False)).unionByName(m.withColumn("asked", F.lit(True)))
    within = F.max("seq").over(W.partitionBy("branch_id", "span").orderBy("moment").rangeBetween(W.unboundedPreceding, 0))
    found = both.withColumn("within", within).where("asked")
    spans = both.groupBy("branch_id", "span").agg(F.max("seq").alias("last"))
    before = spans.select("branch_id", "span", F.max("last").over(W.partitionBy("branch_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    return found.join(before, ["branch_id", "span"], "left").select("branch_id", "moment", F.coalesce("within", "before").alias("seq"))
