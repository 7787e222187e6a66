"""Token ids as compressed binary: one zstandard frame per document, a shared dictionary, an offset index.

A table of segments holds the ids. A segment is a byte image:

    magic "TMTK2" | 32-byte SHA-256 of the dictionary | u32 documents
    per document: i64 doc_id | u32 ids | u32 offset of its frame | u32 size of its frame | u8, 0 for a null doc_id
    frames

Ids are little-endian unsigned 32-bit integers inside the frames. Segments are numbered (shard,
segment) in ascending doc_id order, null first, so one document is read from one segment by its index entry alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import draw, materialize, release, ship, slices_of
from tidemark.llm.word_cache import encoder

MAGIC = b"TMTK2"
END_ID = 2
SEGMENT_BYTES = 2 << 20
#: Compressed bytes of a shard: the least and the most. Between them there are SHARDS shards.
SHARD_LEAST, SHARD_MOST, SHARDS = 16 << 20, 512 << 20, 512
BLOCK, BLOCKS = 4096, 16
_ENTRY = struct.Struct("<qIIIB")
_INDEX = np.dtype([("doc", "<i8"), ("n", "<u4"), ("at", "<u4"), ("size", "<u4"), ("known", "u1")])
_HEAD = struct.Struct("<5s32sI")


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample: int = 256, size: int = 64 << 10) -> bytes:
    """A dictionary over the serialized ids of the sample texts with the least hash, equal ones once.

    The sample is a documented bound; it only shapes compression. Of a text, BLOCKS blocks of BLOCK bytes at most,
    spread over all of it, reach the driver. Too little data gives an empty dictionary. Null texts are drawn too, as one
    without ids: so the rows are counted without a scan of the texts.
    """

    def spread(text: str, h: int) -> bytes:
        ids = encoder(tokenizer_path).encode_bytes([text or ""])[0]
        n = -(-len(ids) // BLOCK)
        return b"".join(ids[i * BLOCK : (i + 1) * BLOCK] for i in sorted({k * n // BLOCKS for k in range(BLOCKS)} if n > BLOCKS else range(n)))

    blocks = [r.blob[i : i + BLOCK] for r in draw(docs.select("text"), ["text"], sample, spread) for i in range(0, len(r.blob), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 8]
    if len(blocks) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def frames(docs: DataFrame, tokenizer_path: str, dictionary: bytes) -> DataFrame:
    """doc_id, n_tokens (with the end id) and the compressed ids of each whole text. Null text: only the end id."""
    ship(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        compress = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary)).compress
        encode = encoder(tokenizer_path).encode_bytes
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices_of(texts):
                raw = [x + end for x in encode([t or "" for t in texts.slice(a, b - a).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([compress(x) for x in raw], pa.binary())],
                    names=["doc_id", "n_tokens", "frame"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def pack_segment(dictionary_hash: bytes, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    head, entries, at = _HEAD.pack(MAGIC, dictionary_hash, len(rows)), [], 0
    for doc_id, n, frame in rows:
        entries.append(_ENTRY.pack(doc_id or 0, n, at, len(frame), doc_id is not None))
        at += len(frame)
    return b"".join([head, *entries, *(r[2] for r in rows)])


def read_segment(image: bytes, dictionary: bytes):
    """Yields (doc_id, number of ids, raw ids) in order; the dictionary's hash must be the stored one."""
    magic, digest, n = _HEAD.unpack_from(image)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token segment of this dictionary")
    decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    base = _HEAD.size + n * _ENTRY.size
    for i in range(n):
        doc_id, count, at, size, known = _ENTRY.unpack_from(image, _HEAD.size + i * _ENTRY.size)
        yield doc_id if known else None, count, decompress(image[base + at : base + at + size], max_output_size=4 * count)


def read_document(image: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """One document's ids, from its index entry: the other frames stay compressed."""
    magic, digest, n = _HEAD.unpack_from(image)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token segment of this dictionary")
    index = np.frombuffer(image, dtype=_INDEX, count=n, offset=_HEAD.size)
    first = int(np.searchsorted(index["known"], 1))
    i = first + int(np.searchsorted(index["doc"][first:], doc_id))
    if i >= n or index["doc"][i] != doc_id:
        return None
    base = _HEAD.size + n * _ENTRY.size + int(index["at"][i])
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(image[base : base + int(index["size"][i])], max_output_size=4 * int(index["n"][i]))
    return np.frombuffer(raw, dtype="<u4")


def write_segments(framed: DataFrame, dictionary: bytes, shards: int) -> DataFrame:
    """(shard, segment, n_tokens, image), written to the shared folder in ascending doc_id order and reread.

    Shards are ranges of doc_id and, within it, of the frame's hash, so that one id that many rows repeat takes
    as many shards as it needs. Rows that repeat an id are ordered by that hash.
    """
    digest = hashlib.sha256(dictionary).digest()

    def run(batches):
        shard, segment, rows, held = None, 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([sum(r[1] for r in rows)], pa.int64()), pa.array([pack_segment(digest, rows)], pa.binary())],
                names=["shard", "segment", "n_tokens", "image"],
            )

        for batch in batches:
            for shard, doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns)):  # a task has one shard
                if held >= SEGMENT_BYTES:
                    yield flush()
                    segment, rows, held = segment + 1, [], 0
                rows.append((doc_id, n, frame))
                held += len(frame)
        if rows:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranged = framed.withColumn("tie", F.xxhash64("frame")).repartitionByRange(shards, *order).sortWithinPartitions(*order, "frame")
    numbered = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "frame")
    return materialize(numbered.mapInArrow(run, "shard int, segment int, n_tokens long, image binary"), "segments", codec="uncompressed")


def shards_for(size: int) -> int:
    return max(1, -(-size // min(SHARD_MOST, max(SHARD_LEAST, size // SHARDS))))


def encode_corpus(docs: DataFrame, tokenizer_path: str, shards: int | None = None) -> tuple[DataFrame, bytes]:
    """Writes every document's ids; returns the table of segments and the dictionary.

    There are as many shards as the compressed bytes need. Null ids come first, null text has the end id alone,
    repeated rows stay repeated, other columns are ignored whatever their names. An empty table gives no segments.
    """
    dictionary = train_dictionary(docs, tokenizer_path)
    framed = materialize(frames(docs, tokenizer_path, dictionary), "frames", codec="uncompressed")
    if shards is None:
        shards = shards_for(framed.agg(F.sum(F.octet_length("frame"))).first()[0] or 0)
    segments = write_segments(framed, dictionary, shards)
    release(framed)
    return segments, dictionary


def read_index(segments: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written segments.

    start counts the ids of all documents before it in the order of the segments.
    """
    ship(segments.sparkSession)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = segments.select("shard", "segment", "n_tokens").withColumn("seg_start", F.sum("n_tokens").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_tokens"))
    starts = within.join(before, "shard").select("shard", "segment", (F.col("seg_start") + F.col("shard_start")).alias("at"))

    def run(batches):
        for batch in batches:
            for shard, segment, image in zip(*(c.to_pylist() for c in batch.columns)):
                rows, at = [], 0
                for doc_id, n, raw in read_segment(image, dictionary):
                    rows.append((doc_id, at, n, zlib.crc32(raw), shard, segment))
                    at += n
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "local", "n_tokens", "ids_crc32", "shard", "segment"])

    read = segments.select("shard", "segment", "image").mapInArrow(run, "doc_id long, local long, n_tokens long, ids_crc32 long, shard int, segment int")
    return read.join(starts, ["shard", "segment"]).select("doc_id", (F.col("at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
