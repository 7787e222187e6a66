"""Live tables from files, the catalog, or a database over JDBC; their columns and unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.values import kind_of

FILE_FORMATS = ("parquet", "orc", "csv", "json", "avro")


def detect(source: str) -> str:
    """postgres, mysql, a file format, or table."""
    scheme = source.split(":", 1)[0].lower() if ":" in source else ""
    if scheme == "jdbc":
        return detect(source.split(":", 1)[1])
    if scheme in ("postgres", "postgresql"):
        return "postgres"
    if scheme in ("mysql", "mariadb"):
        return "mysql"
    tail = source.rstrip("/").rsplit(".", 1)[-1].lower()
    return tail if tail in FILE_FORMATS else "parquet" if "/" in source else "table"


def open_table(spark: SparkSession, source: str, table: str | None = None, **options: str) -> DataFrame:
    """A live table. A database needs its JDBC driver on the class path; partitionColumn and bounds go in options."""
    kind = detect(source)
    if kind in ("postgres", "mysql"):
        url = source if source.startswith("jdbc:") else "jdbc:" + source.replace("postgres://", "postgresql://", 1)
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if kind == "table":
        return spark.table(source)
    return spark.read.options(**options).format(kind).load(source)


def introspect(df: DataFrame) -> list[dict]:
    """Columns in order: id, name, type, nullable, kind (None where versioned tracking refuses it)."""
    return [{"id": i, "name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "kind": kind_of(f.dataType)} for i, f in enumerate(df.schema.fields, 1)]
