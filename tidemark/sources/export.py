"""Exports of a table's history as newline-delimited JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import display


def records(header: dict, columns: DataFrame, commits: DataFrame, versions: DataFrame, value_columns: list[str]) -> DataFrame:
    """One line per record, in this order of parts: header, column, commit, version. Values are text."""
    spark = versions.sparkSession
    first = spark.range(1).select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("header").alias("record"), *[F.lit(v).alias(k) for k, v in header.items()])).alias("value"))
    cols = columns.select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("column").alias("record"), *columns.columns)).alias("value"))
    notes = commits.select(F.lit(2).alias("part"), F.to_json(F.struct(F.lit("commit").alias("record"), *commits.columns)).alias("value"))
    types = {f.name: f.dataType for f in versions.schema.fields}
    values = F.struct(*[display(F.col(c), types[c]).alias(c) for c in value_columns])
    rows = versions.select(F.lit(3).alias("part"), F.to_json(F.struct(F.lit("version").alias("record"), "branch_id", "seq_from", "op", values.alias("values"))).alias("value"))
    return first.unionByName(cols).unionByName(notes).unionByName(rows)


def write(lines: DataFrame, path: str) -> None:
    """Parts become folders, so a reader takes them in order without a global sort of the versions."""
    lines.write.mode("overwrite").partitionBy("part").text(path)
