"""Filtered reads, branch reads, diffs and merges over a version log of $BENCH_VERSIONS (51.4 million) versions.

Ten million keys in versions of their own on main, and a chain of seven branches over it with 200,000 rows each. The
log is written to $BENCH_LOG_DIR, or a temporary folder that goes afterwards. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.functions.predicates import Col  # noqa: E402
from tidemark.operators import history, merge  # noqa: E402
from tidemark.plans.resolve import candidate_resolve, resolve  # noqa: E402


def write_log(spark: SparkSession, path: str, versions: int) -> None:
    keys, overlay = max(8, versions * 10 // 51), max(1, versions // 250)
    row = lambda branch, seq, k, op: [F.lit(branch).alias("branch_id"), seq.cast("long").alias("seq_from"), op.cast("int").alias("op"), F.lit(None).cast("string").alias("session_id"), k.alias("k"), F.pmod(F.xxhash64(k, seq), F.lit(1000)).alias("a"), F.concat(F.lit("row "), k.cast("string")).alias("b")]
    i = F.col("id")
    main = spark.range(versions - 7 * overlay).select(*row("main", F.floor(i / keys), i % keys, F.when(i < keys, 1).otherwise(2)))
    main.write.partitionBy("branch_id").parquet(path)
    for n in range(1, 8):
        over = spark.range(overlay).select(*row(f"b{n}", F.lit(1), (i * 37 + n) % keys, F.when(i % 10 == 0, 3).otherwise(2)))
        over.write.mode("append").partitionBy("branch_id").parquet(path)


def main() -> None:
    versions, cpus = int(os.environ.get("BENCH_VERSIONS", "51400000")), os.environ.get("BENCH_CPUS", "8")
    path = os.environ.get("BENCH_LOG_DIR") or tempfile.mkdtemp(prefix="bench-log-") + "/log"
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.driver.memory", "10g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    write_log(spark, path, versions)
    took = {"write": round(time.time() - began, 1)}
    log = spark.read.parquet(path)
    where = Col("a") == 7
    chains = {d: [*((f"b{n}", 1) for n in range(d - 1, 0, -1)), ("main", 10)] for d in (1, 3, 8)}

    def timed(name: str, df) -> None:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 1)

    for depth, chain in chains.items():
        timed(f"filtered_{depth}", candidate_resolve(log, chain, ["k"], where))
    for depth in (1, 8):
        timed(f"filtered_one_pass_{depth}", resolve(log, chains[depth], ["k"], where=where))
        timed(f"branch_{depth}", resolve(log, chains[depth], ["k"]))
    timed("key_8", resolve(log, chains[8], ["k"], where=Col("k") == 77))
    timed("diff", history.diff(log, chains[3], 0, 1, ["k"], {1: "k", 2: "a", 3: "b"}))
    sides = merge.three_way_scan(log, [("main", 10)], [("main", 10)], chains[3], ["k"], ["a", "b"])
    timed("merge", merge.merge_changes(merge.judge(sides, ["k"], ["a", "b"]), ["k"], ["a", "b"]))
    print(json.dumps({"metric": "seconds over a version log", "versions": versions, "queries": took}))
    spark.stop()
    if not os.environ.get("BENCH_LOG_DIR"):
        shutil.rmtree(os.path.dirname(path), ignore_errors=True)


if __name__ == "__main__":
    main()
