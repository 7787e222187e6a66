"""What the operators of this subpackage share: shared-folder tables, worker paths, samples, joins with hot keys."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.workers import ship  # noqa: F401

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_METHOD = "spark.sql.codegen.hugeMethodLimit"
ROWS_A_FILE = 500_000
#: What operators keep in a Python worker between its tasks, by name.
_KEPT: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """A column name that is none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def kept(name: str) -> dict:
    """A worker's store of what an operator loads once, such as a tokenizer."""
    return _KEPT.setdefault(name, {})


def keep_only(*names: str) -> None:
    """Empties the stores of all other operators: workers go from one operator to the next, and memory with them."""
    for name, store in _KEPT.items():
        if name not in names:
            store.clear()


def _at(spark: SparkSession, path: str):
    """(file system, path) of a folder that any Hadoop file system may hold."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        fs, where = _at(spark, found)
        fs.deleteOnExit(where)
    return found.rstrip("/")


@contextlib.contextmanager
def _set_to(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffle_cleanup(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of the writes inside go when each write ends."""
    return _set_to(spark, _CLEANUP, "true")


def split_methods(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Writes inside split long conditions into methods that the JVM compiles: it interprets those of over 8000 bytes."""
    return _set_to(spark, _METHOD, "8000")


def materialize(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, files: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    With rows, a bound on narrow rows that is known, there is one file for each ROWS_A_FILE of them, not one for each
    shuffle partition. With files, all tasks compute and the rows are dealt anew to so many that write: each file that
    Spark creates in a local folder starts a process. The folder goes when the driver ends, or before that by release.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    with shuffle_cleanup(spark):
        dealt = df.repartition(files) if files else df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        dealt.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes the folders of materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "scratch", None)):
            fs, where = _at(t.sparkSession, path)
            fs.delete(where, True)


def bucket_of(column: str, modulus: int):
    """crc32 of the column as text, modulo: the folds that labels are learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hash_of(keys: list[str]) -> Column:
    """63 bits of the hash of keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1)


def hash_cut(df: DataFrame, keys: list[str], n: int) -> int | None:
    """The n-th least of the distinct hashes of keys (the greatest where there are fewer); None without rows.

    Hashes alone move. Rows that share their keys count once, so a large group of copies takes one place.
    """
    rows = df.count()
    share = min(1.0, 8 * n / max(rows, 1))
    while rows:
        low = df.select(hash_of(keys).alias("h")).where(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 63)))).distinct()
        found = low.orderBy("h").limit(n).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
        if found.n >= n or share == 1.0:
            return found.h
        share = min(1.0, 16 * share)
    return None


def draw(df: DataFrame, keys: list[str], n: int, blob_of: Callable[[str, int], bytes], extra: tuple[str, ...] = (), most: int = 64 << 20) -> list[Row]:
    """h, extra and blob of n rows of df (text and extra), those with the least distinct hashes h of keys, in order of h.

    blob_of(text, h) runs on the executors and bounds what a text sends. Of the rows, as many as stay within most
    bytes reach the driver.
    """
    cut = hash_cut(df, keys, n)
    if cut is None:
        return []
    ship(df.sparkSession)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            picked, blobs = [], []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    picked.append(i)
                    blobs.append(blob_of(batch.column(batch.num_columns - 1)[i].as_py(), h))
            rows = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(blobs, pa.binary())], names=["h", *extra, "blob"])

    low = df.select(hash_of(keys).alias("h"), *extra, F.col("text").alias("__text")).where(F.col("h") <= cut)
    schema = low.drop("__text").schema.add("blob", "binary")
    found = materialize(low.mapInArrow(run, schema).dropDuplicates(["h"]), "sample")
    held, last = 0, -1
    for r in found.select("h", F.octet_length("blob").alias("size")).orderBy("h").collect():
        held += r.size
        if held > most:
            break
        last = r.h
    rows = found.where(F.col("h") <= last).orderBy("h").collect()
    release(found)
    return rows


def hot_rows(many: DataFrame, one: DataFrame, on: str, most_hot: int = 50_000, least: int = 10_000) -> DataFrame:
    """The rows of one, which has a row a key, whose key least rows of many or more hold; at most most_hot."""
    rows = many.count()
    counts = many.groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") >= max(least, -(-rows // most_hot)))
    return one.limit(0) if counts.isEmpty() else materialize(one.join(counts.select(on), on, "left_semi"), "hot")


def join_hot(many: DataFrame, one: DataFrame, on: str, hot: DataFrame | None = None) -> DataFrame:
    """many joined (inner) with one, which has a row a key, where a few keys may hold most rows of many.

    Hot keys, of which there is a bounded number, meet their rows by a broadcast; so no key of the shuffled join has
    more rows than the bound of hot_rows.
    """
    hot = hot_rows(many, one, on) if hot is None else hot
    if hot.isEmpty():
        return many.join(one, on)
    return many.join(F.broadcast(hot), on).unionByName(many.join(F.broadcast(hot.select(on)), on, "left_anti").join(one, on))


def slices_of(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of an Arrow string array of about limit bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
