"""Canonical bytes and the commit hash chain.

The byte layouts here are fixed: stored hashes depend on them. A leaf digest is one column expression;
the Merkle fold runs in blocks, so that a commit of any size needs one digest per block on the driver.
"""

from __future__ import annotations

import hashlib
import struct
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V
from tidemark.workers import ship

#: Separates these commit ids from all others; a chain written under another domain names it to be verified.
DOMAIN = b"tidemark.commit.v1"
#: Fixed values of the hash format.
LEAF, NODE, EMPTY, COMMIT, SCHEMA = b"\x00", b"\x01", b"\x02", b"\x03", b"\x04"
BLOCK = 4096


def _prefixed(payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + payload


def encode_value(value: Any) -> bytes:
    """The canonical bytes of a Python value."""
    if value is None:
        return bytes([V.NULL])
    if isinstance(value, bool):
        return bytes([V.BOOL, value])
    if isinstance(value, int):
        return bytes([V.INT]) + struct.pack(">q", value)
    if isinstance(value, float):
        if value != value:
            raise ValueError("NaN has no canonical form")
        return bytes([V.FLOAT]) + struct.pack(">d", value + 0.0)
    if isinstance(value, Decimal):
        return bytes([V.NUMERIC]) + _prefixed(V.normalize_decimal(format(value, "f")).encode())
    if isinstance(value, str):
        return bytes([V.TEXT]) + _prefixed(value.encode())
    if isinstance(value, (bytes, bytearray)):
        return bytes([V.BYTES]) + _prefixed(bytes(value))
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return bytes([V.TIME]) + struct.pack(">q", (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds)
    if isinstance(value, date):
        return encode_value(datetime(value.year, value.month, value.day, tzinfo=timezone.utc))
    raise TypeError(f"no kind for {type(value).__name__}")


def _u32(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def _i64(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def _lp(payload: Column) -> Column:
    return F.concat(_u32(F.octet_length(payload)), payload)


def _bytes(*parts: int) -> Column:
    return F.lit(bytes(parts))


def encode_column(value: Column, data_type: T.DataType) -> Column:
    """The canonical bytes of a column, as a binary column."""
    kind = V.kind_of(data_type)
    if kind == V.BOOL:
        body = F.when(value, _bytes(1)).otherwise(_bytes(0))
    elif kind == V.INT:
        body = _i64(value)
    elif kind == V.FLOAT:
        body = double_bits(value.cast("double"))
    elif kind == V.NUMERIC:
        body = _lp(F.to_binary(V.decimal_text(value), F.lit("utf-8")))
    elif kind == V.TEXT:
        body = _lp(F.to_binary(value.cast("string"), F.lit("utf-8")))
    elif kind == V.BYTES:
        body = _lp(value)
    elif kind == V.TIME:
        body = _i64(F.unix_micros(value.cast("timestamp")))
    else:
        raise V.UnsupportedType(f"no kind for {data_type.simpleString()}")
    return F.when(value.isNull(), _bytes(V.NULL)).otherwise(F.concat(_bytes(kind), body))


def double_bits(x: Column) -> Column:
    """The eight big-endian bytes of a double, from arithmetic: sign, exponent, fraction. NaN raises."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    # The logarithm may be one off next to a power of two.
    e0 = F.greatest(guess, F.lit(-1022))
    scaled = lambda e: a / F.pow(F.lit(2.0), (e / 2).cast("int").cast("double")) / F.pow(F.lit(2.0), (e - (e / 2).cast("int")).cast("double"))
    e = F.when(scaled(e0) >= 2, e0 + 1).when((scaled(e0) < 1) & (e0 > -1022), e0 - 1).otherwise(e0)
    m = scaled(e)
    normal = m >= 1
    fraction = F.when(normal, (m - 1) * 4503599627370496.0).otherwise(m * 4503599627370496.0).cast("long")
    exponent = F.when(normal, (e + 1023).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(0x7FF0000000000000)).otherwise(F.shiftleft(exponent, 52).bitwiseOR(fraction))
    signed = F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
    return F.when(F.isnan(x), F.raise_error(F.lit("NaN has no canonical form")).cast("binary")).otherwise(_i64(signed))


def encode_key(keys: list[tuple[Column, T.DataType]]) -> Column:
    return F.concat(_u32(F.lit(len(keys))), *[encode_column(c, t) for c, t in keys])


def encode_row(columns: list[tuple[int, Column, T.DataType]]) -> Column:
    return F.concat(_u32(F.lit(len(columns))), *[x for i, c, t in columns for x in (_u32(F.lit(i)), encode_column(c, t))])


def mask_words(changed: Column, n_columns: int) -> Column:
    """A mask's 64-bit words, big-endian, without zero words at the end."""

    def word(w: int) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))
        return F.aggregate(changed, F.lit(0).cast("long"), lambda acc, i: F.when(F.floor(i / 64) == w, acc.bitwiseOR(bit(i))).otherwise(acc))

    words = [word(w) for w in range(n_columns // 64 + 1)]
    out = None
    for k in range(len(words), 0, -1):
        full = F.concat(*[_i64(x) for x in words[:k]])
        out = F.when(words[k - 1] != 0, full) if out is None else out.when(words[k - 1] != 0, full)
    return out.otherwise(F.lit(b""))


def leaf_digest(table_id: int, op: Column, changed: Column, keys: list[tuple[Column, T.DataType]], row: list[tuple[int, Column, T.DataType]]) -> Column:
    """The SHA-256 of one change, as binary; a delete has no row."""
    words = mask_words(changed, max((i for i, _, _ in row), default=0))
    body = F.concat(
        F.lit(LEAF), F.lit(struct.pack(">Q", table_id)), _lp(encode_key(keys)), F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")), _lp(words), F.when(op == V.DELETE, F.lit(b"")).otherwise(encode_row(row))
    )
    return F.unhex(F.sha2(body, 256))


def fold(nodes: list[bytes]) -> bytes:
    """The Merkle root of nodes in order; an odd node goes up as it is."""
    if not nodes:
        return hashlib.sha256(EMPTY).digest()
    while len(nodes) > 1:
        nodes = [hashlib.sha256(NODE + nodes[i] + nodes[i + 1]).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def merkle_root(leaves: DataFrame, column: str = "leaf") -> bytes:
    """The root over the sorted leaves. Blocks of BLOCK leaves fold on the executors, their roots on the driver."""
    spark = leaves.sparkSession
    ship(spark)
    ordered = leaves.select(F.col(column).alias("leaf")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf").sortWithinPartitions("leaf").persist()
    try:
        sizes = {r.p: r.n for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
        offset, at = {}, 0
        for p in sorted(sizes):
            offset[p], at = at, at + sizes[p]

        def cut(batches):
            place = None
            for batch in batches:
                if place is None:
                    place = offset[batch.column(0)[0].as_py()]
                digests = batch.column(1).to_pylist()
                i = 0
                while i < len(digests):
                    take = min(len(digests) - i, BLOCK - place % BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([place // BLOCK]), pa.array([place]), pa.array([b"".join(digests[i : i + take])], pa.binary())], names=["block", "place", "body"])
                    i, place = i + take, place + take

        def root(batches):
            for batch in batches:
                out = [fold([p["body"][i : i + 32] for p in parts for i in range(0, len(p["body"]), 32)]) for parts in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "root"])

        parts = ordered.select(F.spark_partition_id().alias("p"), "leaf").mapInArrow(cut, "block long, place long, body binary")
        blocks = parts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("parts")).mapInArrow(root, "block long, root binary")
        return fold([bytes(r.root) for r in sorted(blocks.collect(), key=lambda r: r.block)])
    finally:
        ordered.unpersist()


def schema_digest(table_id: int, columns: list[tuple[int, str, str, bool, bool]]) -> bytes:
    """columns: id, name, type, nullable, in the key."""
    body = SCHEMA + struct.pack(">QI", table_id, len(columns))
    for i, name, kind, nullable, key in sorted(columns):
        body += struct.pack(">I", i) + _prefixed(name.encode()) + _prefixed(kind.encode()) + bytes([nullable | key << 1])
    return hashlib.sha256(body).digest()


def commit_id(repo: bytes, parents: list[bytes], change: bytes, schema: bytes, author: str, micros: int, message: str, external: str = "", domain: bytes = DOMAIN) -> bytes:
    body = COMMIT + _prefixed(domain) + repo + struct.pack(">I", len(parents)) + b"".join(sorted(parents)) + change + schema
    body += _prefixed(author.encode()) + struct.pack(">q", micros) + _prefixed(message.encode()) + _prefixed(external.encode())
    return hashlib.sha256(body).digest()
