"""Media payloads stored as content-defined chunks.

A rolling gear hash over the last 32 bytes cuts a payload where its high bits are zero, into chunks small enough
that a text of a few pages has several. Chunks are named by their SHA-256; a chunk that many payloads share is
stored once. The media object of a payload is its chunk list:

    magic "TMCH1" | i64 payload bytes | u32 chunks | per chunk: 32-byte digest, u32 bytes

The payload is read back from the stored list by joining it with the written chunk table; the chunks are verified
against the list, and the whole against the payload's own digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _at, draw, hot_rows, join_hot, keep_only, materialize, release, shared_dir, ship, shuffle_cleanup, slices_of

MAGIC = b"TMCH1"
UNIT = 64
LEAST, MEAN_BITS, MOST = 512, 10, 8 << 10
WINDOW = 32
LEVEL = 19
#: Payloads are read back in so many rounds at most, of ROUND_BYTES at least: chunks on their way take that share of the disk.
ROUNDS, ROUND_BYTES = 4, 64 << 20
#: Rows of a file of lists or features.
ROWS_A_FILE = 50_000
#: Bytes of a sample text's block for the dictionary, and blocks of a text.
BLOCK, BLOCKS = 2048, 32
#: Chunks broadcast at most when payloads are read back: 32 MB.
HOT_CHUNKS = 4096


def _gear() -> np.ndarray:
    """256 fixed 32-bit values from a multiplicative generator."""
    out, x = [], 0x2545F491
    for _ in range(256):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append((x ^ x >> 15) * 0x9E3779B1 & 0xFFFFFFFF)
    return np.array(out, dtype=np.uint32)


GEAR = _gear()


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def cuts(payload: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """The ends of the chunks, in order; the last is the payload's length."""
    n = len(payload)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(payload, dtype=np.uint8)]
    # The gear hash of a window: sum of GEAR[b] << age, by doubling the window.
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    found = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(found, at + least))
        end = int(found[i]) if i < len(found) else n
        at = min(end, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def pack_list(size: int, chunks: list[tuple[bytes, int]]) -> bytes:
    return MAGIC + struct.pack("<qI", size, len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


def unpack_list(media: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    size, n = struct.unpack_from("<qI", media, 5)
    if media[:5] != MAGIC:
        raise ValueError("not a chunk list")
    return size, [(media[17 + 36 * i : 49 + 36 * i], struct.unpack_from("<I", media, 49 + 36 * i)[0]) for i in range(n)]


def feature_of(payload: bytes) -> str:
    """The share of each quarter of the 8-bit range, in thousandths, and the mean sample."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples >> 6, minlength=4) * 1000 // len(samples)
    return ",".join(str(int(x)) for x in [*share, int(samples.sum(dtype=np.int64)) // len(samples)])


def _dictionary(docs: DataFrame, sample: int = 400, size: int = 96 << 10) -> bytes:
    """A compression dictionary over the sample texts with the least hash, equal ones once; it shapes the stored size alone.

    Of a text, BLOCKS blocks at most, spread over all of it, reach the driver.
    """

    def spread(text: str, h: int) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        n = -(-len(raw) // BLOCK)
        return b"".join(raw[i * BLOCK : (i + 1) * BLOCK] for i in sorted({k * n // BLOCKS for k in range(BLOCKS)} if n > BLOCKS else range(n)))

    blocks = [r.blob[i : i + BLOCK] for r in draw(docs.where("length(text) > 0").select("text"), ["text"], sample, spread) for i in range(0, len(r.blob), BLOCK)]
    if len(blocks) < 32:
        return b""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b""


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_key (SHA-256 of the payload) and media (its chunk list) of every row."""

    def run(batches):
        keep_only()
        for batch in batches:
            for a, b in slices_of(batch.column(1)):
                rows = []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    n, payload = payload_of(t)
                    rows.append((n, hashlib.sha256(payload).digest(), pack_list(len(payload), [(hashlib.sha256(c).digest(), len(c)) for c in chunks_of(payload)])))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["doc_id", "n_bytes", "media_key", "media"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media_key binary, media binary")


def _store(docs: DataFrame, dictionary: bytes, spark: SparkSession) -> tuple[str, str]:
    """Writes each distinct chunk once, in buckets of its digest; returns the table's name and folder."""

    def run(batches):
        plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False)
        compress = zstandard.ZstdCompressor(compression_params=plain, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        seen: set[bytes] = set()
        for batch in batches:
            for a, b in slices_of(batch.column(0)):
                new: dict[bytes, bytes] = {}
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    for c in chunks_of(payload_of(t)[1]):
                        d = hashlib.sha256(c).digest()
                        if d not in seen and d not in new:
                            new[d] = compress(c)
                if len(seen) > 100_000:  # what is dropped here goes in the shuffle
                    seen.clear()
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.binary()), pa.array(new.values(), pa.binary())], names=["digest", "body"])

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/tidemark/{name}"
    rows = docs.select("text").mapInArrow(run, "digest binary, body binary").dropDuplicates(["digest"])
    with shuffle_cleanup(spark):
        rows.write.option("compression", "uncompressed").option("path", folder).bucketBy(buckets, "digest").saveAsTable(name)
    return name, folder


def references(keys: DataFrame) -> DataFrame:
    """k, pos, digest of every chunk of the stored lists (k, media_key, media); the first carries key and list."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                out = []
                for k, key, media in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns)):
                    out += [(k, n, d, None if n else key, None if n else media) for n, (d, _) in enumerate(unpack_list(media)[1])]
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["k", "pos", "digest", "media_key", "media"])

    return keys.mapInArrow(run, "k long, pos int, digest binary, media_key binary, media binary")


def read_back(keys: DataFrame, store: DataFrame, dictionary: bytes, rounds: int = ROUNDS, files: int | None = None) -> DataFrame:
    """Rebuilds each media object from its stored list and the chunk table, verifies it, and computes its columns.

    Each of the rounds writes so many files.
    """

    def rebuild(batches):
        decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
        for batch in batches:
            rows = []
            for found in batch.column(0):
                parts = found.as_py()
                key, media = parts[0]["media_key"], parts[0]["media"]
                size, listed = unpack_list(media)
                chunks = [decompress(p["body"], max_output_size=MOST) for p in parts]
                payload = b"".join(chunks)
                if [(hashlib.sha256(c).digest(), len(c)) for c in chunks] != listed or len(payload) != size or hashlib.sha256(payload).digest() != key:
                    raise ValueError(f"media {key.hex()} is damaged")
                rows.append((key, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["media_key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    # A line that a third of all payloads share is one chunk.
    hot, out = hot_rows(references(keys), store, "digest", HOT_CHUNKS), None
    for r in range(rounds):
        joined = join_hot(references(keys.where(F.pmod("k", F.lit(rounds)) == r)), store, "digest", hot)
        whole = joined.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "media_key", "media", "body"))).alias("parts"))
        part = materialize(whole.select("parts").mapInArrow(rebuild, "media_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"), "media-features", files=files)
        out = part if out is None else out.unionByName(part)
    release(hot)
    return out


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row.

    Null text counts as empty: 64 zero bytes. Equal texts share one media object, null and repeated ids stay as they
    are, other columns are ignored, an empty table gives no rows. A payload is rebuilt in memory as a whole.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = _dictionary(rows)
    files = max(1, -(-rows.count() // ROWS_A_FILE))
    listed = materialize(index(rows), "media-index", files=files)
    rounds = min(ROUNDS, max(1, -(-(listed.agg(F.sum("n_bytes")).first()[0] or 0) // ROUND_BYTES)))
    name, folder = _store(rows, dictionary, spark)
    keys = materialize(listed.select("media_key", "media").dropDuplicates(["media_key"]).withColumn("k", F.monotonically_increasing_id()).select("k", "media_key", "media"), "media-keys", files=files)
    features = read_back(keys, spark.table(name), dictionary, rounds, -(-files // rounds))
    spark.sql(f"DROP TABLE {name}")
    fs, where = _at(spark, folder)
    fs.delete(where, True)
    release(keys)
    return join_hot(listed.select("doc_id", "n_bytes", "media_key"), features, "media_key").drop("media_key")
