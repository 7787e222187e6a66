"""Commits from a stream of changes, each micro-batch once.

The batch's number is the commit's idempotency key: a batch that is replayed after a failure finds its commit
and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.repository import Repository


def latest(changes: DataFrame, pk: list[str], order: str) -> DataFrame:
    """The last change of each key, by order; map-side partial, one row per key and task is shuffled."""
    rest = [c for c in changes.columns if c not in pk]
    return changes.groupBy(*pk).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*pk, *[F.col(f"x.{c}").alias(c) for c in rest])


def ingest(stream: DataFrame, repo: Repository, table: str, checkpoint: str, author: str, branch: str = "main", order: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that commits every micro-batch of changes (columns, optional op) to a branch."""
    version = repo.schema(table, branch)
    pk = repo._keys(table, version)

    def commit(batch: DataFrame, number: int) -> None:
        repo.refresh()
        rows = latest(batch, pk, order).drop(order) if order else batch
        repo.commit(table, rows, branch, author, f"stream batch {number}", idempotency_key=f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
