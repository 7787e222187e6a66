"""Retention and verification over version logs: prune, garbage, purge, drift, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.values import MAX_SEQ, same_row
from tidemark.plans.resolve import intervals


def prune_cutoff(commits: list[dict], now_micros: int, keep_days: int | None, keep_commits: int | None, pinned: list[int]) -> int:
    """The seq up to which history may go: the later of both policies, but below every seq that a chain pins."""
    seqs = sorted(c["seq"] for c in commits)
    cut = 0
    if keep_days is not None:
        cut = max([cut, *(c["seq"] for c in commits if c["at"] <= now_micros - keep_days * 86_400_000_000)])
    if keep_commits is not None and len(seqs) > keep_commits:
        cut = max(cut, seqs[-keep_commits - 1])
    return min([cut, *pinned])


def prune(log: DataFrame, branch: str, cutoff: int, pk: list[str]) -> DataFrame:
    """The log without the closed versions that end by cutoff, but for each key's oldest, which then covers them.

    Open versions, later ones and other branches stay.
    """
    full = intervals(log, pk).where(F.col("branch_id") == branch)
    old = F.col("seq_to") <= cutoff
    rank = F.row_number().over(W.partitionBy(*pk).orderBy("seq_from"))
    kept = full.withColumn("__old", old).withColumn("__rn", rank).where(~F.col("__old") | (F.col("__rn") == 1))
    rest = log.where((F.col("branch_id") != branch) | F.col("session_id").isNotNull())
    return kept.select(*log.columns).unionByName(rest)


def prune_report(log: DataFrame, branch: str, cutoff: int, pk: list[str]) -> DataFrame:
    """Per key with more than one such version: how many go, and the interval that stays."""
    full = intervals(log, pk).where((F.col("branch_id") == branch) & (F.col("seq_to") <= cutoff))
    return full.groupBy(*pk).agg(F.count("*").alias("n"), F.min("seq_from").alias("seq_from"), F.max("seq_to").alias("seq_to")).where("n > 1").select(*pk, (F.col("n") - 1).alias("removed"), "seq_from", "seq_to")


def collect_garbage(log: DataFrame, branches: DataFrame) -> DataFrame:
    """The log without versions of branches that no longer exist."""
    return log.join(F.broadcast(branches.select("branch_id").distinct()), "branch_id", "left_semi").select(*log.columns)


def purge(log: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """The log without any version of the keys, on any branch or session."""
    return log.join(keys.select(*pk).distinct(), pk, "left_anti").select(*log.columns)


def drift(live: DataFrame, resolved: DataFrame, pk: list[str], values: list[str]) -> DataFrame:
    """One row: keys only live, only versioned, and with other values."""
    a = live.select(*pk, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("__a"))
    b = resolved.select(*pk, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("__b"))
    j = a.join(b, pk, "full_outer")
    same = same_row([F.col(f"a_{v}") for v in values], [F.col(f"b_{v}") for v in values])
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("__b").isNull()).alias("live_only"), n(F.col("__a").isNull()).alias("version_only"), n(F.col("__a") & F.col("__b") & ~same).alias("mismatched"))


def interval_faults(stored: DataFrame, pk: list[str]) -> DataFrame:
    """Faults of stored intervals: overlap, gap (to the next version), open (an earlier version without an end)."""
    nxt = F.lead("seq_from").over(W.partitionBy("branch_id", *pk).orderBy("seq_from", "seq_to"))
    marked = stored.withColumn("__next", nxt).where(F.col("__next").isNotNull())
    fault = F.when(F.col("seq_to") == MAX_SEQ, "open").when(F.col("__next") < F.col("seq_to"), "overlap").when(F.col("__next") > F.col("seq_to"), "gap")
    return marked.withColumn("fault", fault).where("fault is not null").select("branch_id", *pk, "seq_from", "seq_to", F.col("__next").alias("next_from"), "fault")


def open_versions(stored: DataFrame, pk: list[str]) -> DataFrame:
    """Keys with more than one open version on a branch."""
    return stored.where(F.col("seq_to") == MAX_SEQ).groupBy("branch_id", *pk).agg(F.count("*").alias("n")).where("n > 1")
