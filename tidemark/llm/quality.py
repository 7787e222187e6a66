"""Document quality by naive Bayes support vectors.

Indicators of n-grams (words and pairs of words; runs of one to three word shapes) are hashed into
FEATURES slots. Each is scaled by its class log-count ratio, and a linear hinge-loss model over the scaled
indicators is fitted by dual coordinate descent. The margin becomes a probability by a logistic curve
fitted to documents that the model was not fitted to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import draw, keep_only, ship, slices_of

BITS = 18
FEATURES = 1 << BITS
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
#: Classes of bytes: 0 lower case and beyond ASCII, 1 upper case, 2 digit, 3 other ASCII.
_KIND = np.full(256, 3, dtype=np.int64)
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.full(64, 0x100000001B3, dtype=np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every indicator that is set, in order, each pair once."""
    buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(ends_of, begin, side="right")
    size = end - begin
    # Hashes and shapes, word by word, over the letters alone.
    letters = buf[word]
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    code = np.add.reduceat((_LOWER[letters] + np.uint64(1)) * _POWER[place & 63], first)
    kind = _KIND[letters]
    upper = np.add.reduceat((kind == 1).astype(np.int64), first)
    other = np.add.reduceat((kind == 3).astype(np.int64), first)
    same = np.zeros(len(begin), dtype=np.int64)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    long = np.searchsorted(np.array([2, 4, 8, 16]), size, side="right")
    shape = ((((_KIND[buf[begin]] * 4 + _KIND[buf[end - 1]]) * 5 + long) * 4 + np.minimum(other, 3)) * 3 + np.minimum(upper, 2)) * 2 + same
    shape = shape.astype(np.uint64)
    docs, feats = [doc, doc], [_mix(code, 1), _mix(shape, 2)]
    for n in (2, 3):
        if len(begin) < n:
            break
        joined = doc[n - 1 :] == doc[: len(doc) - n + 1]
        for source, salt in ((code, 10), (shape, 20)) if n == 2 else ((shape, 20),):
            h = source[: len(source) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint64(0x100000001B3) + source[k : len(source) - n + 1 + k] + np.uint64(k)
            docs.append(doc[n - 1 :][joined])
            feats.append(_mix(h, salt + n)[joined])
    pair = np.unique(np.concatenate(docs) << BITS | np.concatenate(feats))
    return pair >> BITS, pair & (FEATURES - 1)


def sparse_rows(texts: list[bytes], limit: int = 1 << 18) -> list[np.ndarray]:
    """The features of each text, in slices of about limit bytes, so that what is held beside them stays small."""
    rows: list[np.ndarray] = []
    start, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > start and size + len(texts[i]) > limit):
            doc, feat = indicators(texts[start:i])
            bounds = np.searchsorted(doc, np.arange(i - start + 1))
            feat = feat.astype(np.int32)
            rows += [feat[a:b] for a, b in zip(bounds, bounds[1:])]
            start, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return rows


class Model:
    """A weight for each feature, and the curve from margins to scores; the fitted bias is part of its shift."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.slope, self.shift = weights, slope, shift

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, feat = indicators(texts)
        return np.bincount(doc, weights=self.weights[feat], minlength=len(texts)) / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int, seed: int, size: int = FEATURES + 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables by dual coordinate descent for the hinge loss."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size), np.zeros(len(y))
    norm = np.array([float((v * v).sum()) for v in values])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, alpha


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """Of each feature: the log of its share of all indicators of label 1 over its share of those of label 0, each count plus one."""
    p, q = np.ones(size), np.ones(size)
    for row, label in zip(rows, labels):
        (p if label == 1 else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def fit(texts: list[bytes], labels: np.ndarray, **options) -> Model:
    return fit_rows(sparse_rows(texts), labels, **options)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, blend: float = 0.25, passes: int = 12, seed: int = 5) -> Model:
    """rows are the features of each text. Labels are 0 and 1. With one class alone every score is that class."""
    if len(set(labels.tolist())) < 2:
        sure = 4.0 if len(labels) and labels[0] == 1 else -4.0 if len(labels) else 0.0
        return Model(np.zeros(FEATURES), 0.0, sure)
    held = np.arange(len(rows)) % 4 == 3
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held = np.zeros(len(rows), dtype=bool)
    use = np.flatnonzero(~held)
    ratio = log_count_ratio([rows[i] for i in use], labels[use])
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(y[use] < 0).mean(), (y[use] > 0).mean()])
    scale = [1 / np.sqrt(max(len(r), 1)) for r in rows]
    # The last feature is the bias.
    w, _ = _descend([np.append(rows[i], np.int32(FEATURES)) for i in use], [np.append(ratio[rows[i]] * scale[i], 1.0).astype(np.float32) for i in use], y[use], c * np.where(y[use] > 0, share[0], share[1]) * 2, passes, seed)
    mean = np.abs(w[:-1]).sum() / max(1, np.count_nonzero(w[:-1]))
    weights = ((1 - blend) * mean * (w[:-1] != 0) + blend * w[:-1]) * ratio
    calibrate = np.flatnonzero(held) if held.any() else use
    m = np.array([float(weights[rows[i]].sum()) * scale[i] for i in calibrate])
    return Model(weights, *_logistic(m, (y[calibrate] + 1) / 2))


def _logistic(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's steps on the log-likelihood, with targets drawn in by the counts."""
    n1, n0 = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = max(float(np.std(m)), 1e-9)
    x = np.stack([m / unit, np.ones_like(m)], axis=1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 0.0) / unit), float(b[1])


def train(labelled: DataFrame, sample: int = 4000) -> Model:
    """Fits to the sample rows (text, label) with the least hash, equal rows once; null texts and labels are left out.

    sample is the documented bound on labelled rows. The executors send the features of a text, at most 1 MB, not
    the text; of the rows as many are taken as stay within 64 MB.
    """
    rows = draw(labelled.where("text is not null and label is not null").select("text", F.col("label").cast("int").alias("label")), ["text", "label"], sample, _features, ("label",))
    return fit_rows([np.frombuffer(r.blob, dtype=np.int32) for r in rows], np.array([r.label for r in rows], dtype=np.int64))


def _features(text: str, h: int) -> bytes:
    return indicators([text.encode("utf-8", "surrogatepass")])[1].astype(np.int32).tobytes()


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """Adds score and predicted to every row, in place of columns of those names and of text; no shuffle.

    Null text counts as empty, and a text without a word has the score of the curve's shift alone. Equal texts have
    equal scores, rows that repeat stay repeated, and an empty table gives no rows. Texts are judged in slices of
    about 1 MB; a longer one makes a slice by itself.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("score", "predicted", "text")]
    sent = spark.sparkContext.broadcast(model)  # FEATURES weights, whatever the corpus

    def run(batches):
        keep_only()
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices_of(texts):
                s = m.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*keep, F.col("text").cast("string").alias("__quality_input")).mapInArrow(run, schema)
