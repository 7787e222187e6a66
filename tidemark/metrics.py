"""Counters and latency histograms, of a repository on the driver or of a column of measurements."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the buckets in seconds: 1, 2 and 5 of each power of ten; what is longer falls in one more bucket.
BOUNDS = [m * 10.0**e for e in range(-4, 2) for m in (1, 2, 5)] + [100.0]
QUANTILES = (0.5, 0.95, 0.99)


def quantile(counts: list[int], q: float) -> float | None:
    """The upper bound of the bucket in which the share q of all values is reached; None without values."""
    total, seen = sum(counts), 0
    for i, n in enumerate(counts):
        seen += n
        if total and seen >= q * total:
            return BOUNDS[min(i, len(BOUNDS) - 1)]
    return None


class Metrics:
    """Counts of what a repository object did, by chain depth for reads, and the latency of its commits."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.depths: Counter[int] = Counter()
        self.commit_s = [0] * (len(BOUNDS) + 1)

    def read(self, depth: int) -> None:
        self.counts["reads"] += 1
        self.depths[depth] += 1

    def commit(self, rows: int, seconds: float) -> None:
        self.counts["commits"] += 1
        self.counts["rows"] += rows
        self.commit_s[bisect_left(BOUNDS, seconds)] += 1

    def merge(self, clean: bool) -> None:
        self.counts["merges"] += 1
        self.counts["conflicted"] += not clean

    def summary(self) -> dict:
        return {**self.counts, "depths": dict(self.depths), **{f"commit_p{round(100 * q)}": quantile(self.commit_s, q) for q in QUANTILES}}


def histogram(df: DataFrame, seconds: str) -> DataFrame:
    """bucket (its number), up_to (null for the last) and n of every bucket that holds values of a column; nulls are left out."""
    x = F.col(seconds).cast("double")
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in BOUNDS]), lambda b: b < x))
    found = df.where(x.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    bound = F.get(F.array(*[F.lit(b) for b in BOUNDS]), F.col("bucket"))
    return found.select("bucket", bound.alias("up_to"), "n")


def latency_summary(df: DataFrame, seconds: str) -> DataFrame:
    """One row: n, p50, p95, p99, each the upper bound of its bucket. Counts alone meet in one task, one row a bucket."""
    counts = histogram(df, seconds).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(len(BOUNDS))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    rows = counts.select(each.alias("counts")).withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b))
    bounds = F.array(*[F.lit(b) for b in [*BOUNDS, BOUNDS[-1]]])

    def pick(q: float):
        upto = F.transform(F.sequence(F.lit(1), F.lit(len(BOUNDS) + 1)), lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
        first = F.size(F.filter(upto, lambda s: s < q * F.col("n")))
        return F.when(F.col("n") > 0, F.get(bounds, first))

    return rows.select("n", *[pick(q).alias(f"p{round(100 * q)}") for q in QUANTILES])
