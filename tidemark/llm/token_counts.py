"""Token counts by rank-synchronous merging of symbol arrays.

A BPE model with byte fallback is read from its piece list. Pre-tokens are held as one flat array of
symbols with the lengths of its ragged rows. In each step every row applies its own best pair (lowest
rank, leftmost) at once; rows without a pair leave with the count of their symbols. A row longer than
LONG symbols is merged over a linked list with a heap, the same order of merges.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_only, kept, ship, slices_of

SPACE = "▁"
LONG = 1500
#: What a worker's table of known words may hold, and the longest word in it: 600,000 of 64 characters at most.
_ENTRIES, _LETTERS = 600_000, 64
_NONE = np.int64(1 << 30)
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class MergeCounter:
    def __init__(self, path: str, entries: int = _ENTRIES) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        order = sorted(range(len(ids)), key=lambda k: (-model.get_score(ids[k]), k))
        rank = {pieces[k]: r for r, k in enumerate(order)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece crosses a word's end")
        chars = sorted({c for p in pieces for c in p})
        symbol = {p: i for i, p in enumerate(dict.fromkeys([*chars, *pieces]))}
        # Unknown characters of 1 to 4 bytes have the last four symbols.
        self.unknown = len(symbol)
        self.weight = np.ones(len(symbol) + 4, dtype=np.int64)
        self.weight[-4:] = (1, 2, 3, 4)
        for c in chars:
            if c not in rank:
                self.weight[symbol[c]] = len(c.encode())
        self.char = {c: symbol[c] for c in chars}
        keys, ranks, merged = [], [], []
        for p, r in rank.items():
            for i in range(1, len(p)):
                a, b = symbol.get(p[:i]), symbol.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    ranks.append(r)
                    merged.append(symbol[p])
        self._table(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int64), np.array(merged, dtype=np.int64))
        #: Characters that no piece holds right after a letter: words end before them.
        self.breaks = [c for c in ".,\n" if not any(re.search(rf"[^\W_]{re.escape(c)}", p) for p in pieces)]
        self.odd = re.compile("\x01|[\\W_][.,\n]")
        self.entries = entries
        self.known: dict[str, int] = {}

    def _table(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing hash table of pairs, filled round by round."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks, self.merged = np.full(size, _NONE), np.zeros(size, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            at = slot[put]
            self.keys[at], self.ranks[at], self.merged[at] = keys[left[put]], ranks[left[put]], merged[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; _NONE where there is none."""
        keys = a << 24 | b
        slot = self._slot(keys)
        got = self.keys[slot]
        rank, new = np.where(got == keys, self.ranks[slot], _NONE), self.merged[slot]
        todo = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[todo]]
            hit = todo[got == keys[todo]]
            rank[hit], new[hit] = self.ranks[slot[hit]], self.merged[slot[hit]]
            todo = todo[(got != keys[todo]) & (got != -1)]
        return rank, new

    def symbols(self, word: str) -> list[int]:
        get = self.char.get
        return [s if (s := get(c)) is not None else self.unknown + len(c.encode("utf-8", "surrogatepass")) - 1 for c in word]

    def merge(self, words: list[str]) -> list[int]:
        """Surviving symbols of each pre-token, a character that is no piece counting as its bytes."""
        out = np.zeros(len(words), dtype=np.int64)
        rows = [self.symbols(w) for w in words]
        for i, row in enumerate(rows):
            if len(row) > LONG:
                out[i] = self._merge_long(row)
        live = np.array([i for i, row in enumerate(rows) if 0 < len(row) <= LONG], dtype=np.int64)
        if not len(live):
            return out.tolist()
        size = np.array([len(rows[i]) for i in live], dtype=np.int64)
        flat = np.fromiter((s for i in live for s in rows[i]), dtype=np.int64, count=int(size.sum()))
        last = np.zeros(len(flat), dtype=bool)
        last[np.cumsum(size) - 1] = True
        rank, new = self._find(flat, np.append(flat[1:], 0))
        rank[last] = _NONE
        while len(live):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(flat)), begin)
            done = best >> 32 >= _NONE
            if done.any():
                out[live[done]] = np.add.reduceat(self.weight[flat], begin)[done]
                keep = np.repeat(~done, size)
                shift = np.cumsum(~keep)
                at = (best & 0xFFFFFFFF)[~done]
                at = at - shift[at]
                flat, rank, new, last, size, live = flat[keep], rank[keep], new[keep], last[keep], size[~done], live[~done]
            else:
                at = best & 0xFFFFFFFF
            if not len(live):
                break
            flat[at] = new[at]
            last[at] = last[at + 1]
            keep = np.ones(len(flat), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            flat, rank, new, last = flat[keep], rank[keep], new[keep], last[keep]
            size = size - 1
            begin = np.cumsum(size) - size
            near = np.concatenate([at, (at - 1)[at > begin]])
            r, n = self._find(flat[near], flat[np.minimum(near + 1, len(flat) - 1)])
            rank[near], new[near] = np.where(last[near], _NONE, r), n
        return out.tolist()

    def _merge_long(self, row: list[int]) -> int:
        flat = np.array(row, dtype=np.int64)
        rank, new = self._find(flat[:-1], flat[1:])
        after, before = list(range(1, len(row))) + [-1], [-1, *range(len(row) - 1)]
        alive = [True] * len(row)
        heap = [(int(r), i, row[i], row[i + 1], int(n)) for i, (r, n) in enumerate(zip(rank, new)) if r < _NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0:
                r, n = self._find(np.array([row[i]]), np.array([row[j]]))
                if r[0] < _NONE:
                    heapq.heappush(heap, (int(r[0]), i, row[i], row[j], int(n[0])))

        while heap:
            _, i, a, b, n = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or row[i] != a or row[j] != b:
                continue
            row[i], alive[j], after[i] = n, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return int(sum(self.weight[s] for s, ok in zip(row, alive) if ok))

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each whole text; an empty one has none."""
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif "  " in t or SPACE in t or not t[0].isalnum() or t[-1] == " " or self.odd.search(t):
                split.append(_RUNS.findall(SPACE + t.replace(" ", SPACE)))
            else:
                for c in self.breaks:
                    t = t.replace(c, " \x01" + c)
                split.append(t.split(" "))
        known = self.known
        missing = list(set().union(*split).difference(known))
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            known.update(zip(some, self.merge([w[1:] if w[:1] == "\x01" else w if w[:1] == SPACE else SPACE + w for w in some])))
        found = [sum(map(known.__getitem__, words)) for words in split]
        for w in missing if len(known) > self.entries else [w for w in missing if len(w) > _LETTERS]:
            del known[w]
        return found


def counter(path: str) -> MergeCounter:
    """The worker's counter of a model; what other operators keep there goes."""
    keep_only("counts")
    loaded = kept("counts")
    if path not in loaded:
        loaded.clear()
        loaded[path] = MergeCounter(path)
    return loaded[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle.

    Null and empty texts have no bytes and no tokens. Null and repeated ids stay as they are, other columns are
    ignored whatever their names, and an empty table gives no rows. Texts are counted in slices of about 1 MB; a
    longer one makes a slice by itself, and a pre-token of over LONG symbols is merged over a heap.
    """
    ship(docs.sparkSession)

    def run(batches):
        count = counter(model_path).counts
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices_of(texts):
                n = count([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), batch.column(2).slice(a, b - a)], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    got = rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
