"""Best-fit packing by minimum bin slack.

Each bin takes the largest length left and then the fullest combination of the other lengths available,
found by subset-sum dynamic programming on a bitset (bit k: k tokens can be filled). The combination is
removed, as often as the counts allow, and the next bin follows. Pieces are dealt at random into groups
of about ``group_size`` and each group is packed by itself, so at most one bin a group stays part empty.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ship, slices_of
from tidemark.llm.word_cache import encoder

LIMIT = 4096
END_ID = 1
GROUP = 16384


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each whole text's ids with the end id, cut only where over limit."""
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = encoder(tokenizer_path).encode_bytes
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices_of(texts):
                rows = []
                for doc_id, raw in zip(ids.slice(a, b - a).to_pylist(), encode([t or "" for t in texts.slice(a, b - a).to_pylist()])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * limit)):
                        part = raw[at : at + 4 * limit]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) that fill room best, from the available counts; order: the lengths, largest first."""
    reach, full, stages = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left = min(counts[length], room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            after = (reach | reach << (length * take)) & full
            if after != reach:
                stages.append((length, take, reach))
                reach = after
                if reach >> room & 1:
                    left = 0
                    break
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return list(chosen.items())


def pack(lengths: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Bins of lengths; each length is at most limit."""
    counts = Counter(lengths)
    bins: list[list[int]] = []
    order = sorted(counts, reverse=True)
    while order:
        top = order[0]
        counts[top] -= 1
        found = fullest(counts, [x for x in order if x <= limit - top and counts[x] > 0], limit - top) if top < limit else []
        counts[top] += 1
        need = Counter({top: 1})
        need.update(dict(found))
        times = min(counts[x] // n for x, n in need.items())
        content = [x for x, n in need.items() for _ in range(n)]
        bins += [content] * times
        for x, n in need.items():
            counts[x] -= n * times
        order = [x for x in order if counts[x] > 0]
    return bins


def assign(cut: DataFrame, limit: int = LIMIT, group_size: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to written pieces (a table read from files, so that rows keep their numbers)."""
    ship(cut.sparkSession)
    groups = max(1, round(cut.count() / group_size))

    def run(key, frame):
        length = frame["length"].to_numpy()
        rank = np.argsort(-length, kind="stable")
        waiting: dict[int, list[int]] = {}
        for i in rank.tolist():
            waiting.setdefault(int(length[i]), []).append(i)
        sequence = np.zeros(len(frame), dtype=np.int64)
        offset = np.zeros(len(frame), dtype=np.int64)
        for n, content in enumerate(pack(length.tolist(), limit)):
            at = 0
            for x in content:
                i = waiting[x].pop()
                sequence[i], offset[i] = int(key[0]) << 32 | n, at
                at += x
        return frame.drop(columns="g").assign(sequence_id=sequence, offset=offset)

    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place.

    Null and empty texts are one piece, the end id alone. Null and repeated ids stay as they are: each row has pieces
    of its own, numbered from 0. Other columns are ignored, whatever their names. No rows give no rows.
    """
    return assign(materialize(pieces(docs, tokenizer_path, limit, end_id), "pieces"), limit)
