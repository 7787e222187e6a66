"""Language identification with a bidirectional gated recurrent network over UTF-8 bytes, in numpy.

Every document is cut into segments of SEGMENT bytes that together hold the whole text. The network runs
over each segment in both directions and gives a distribution over the languages at every byte; a
document's probabilities are the mean over all its bytes. Training is backpropagation through time on
segments of a bounded sample of labelled documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import draw, keep_only, ship, slices_of

SEGMENT = 128
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_BATCH = 2048


class Network:
    """Weights by direction: table (bytes x 3H), recurrent (H x 3H), recurrent bias of the candidate (H); readout."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = f(256, 3 * hidden, scale=0.3)
            self.w[f"u{d}"] = f(hidden, 3 * hidden, scale=1 / np.sqrt(hidden))
            self.w[f"c{d}"] = np.zeros(hidden, dtype=np.float32)
            self.w[f"o{d}"] = f(hidden, len(langs), scale=1 / np.sqrt(hidden))
        self.w["bias"] = np.zeros(len(langs), dtype=np.float32)

    # Training: arrays are (time, batch, features).

    def _run(self, d: str, data: np.ndarray):
        h_size, (steps, n) = self.hidden, data.shape
        x, u, c = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"c{d}"]
        h = np.zeros((n, h_size), dtype=np.float32)
        trace = []
        for t in range(steps):
            a, g = x[data[t]], h @ u
            z = _sigmoid(a[:, :h_size] + g[:, :h_size])
            r = _sigmoid(a[:, h_size : 2 * h_size] + g[:, h_size : 2 * h_size])
            q = g[:, 2 * h_size :] + c
            k = np.tanh(a[:, 2 * h_size :] + r * q)
            before, h = h, (1 - z) * k + z * h
            trace.append((before, z, r, q, k, h))
        return trace

    def _back(self, d: str, data: np.ndarray, trace, dh_out: np.ndarray, grads: dict) -> None:
        h_size = self.hidden
        u = self.w[f"u{d}"]
        dx, du, dc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros(h_size, dtype=np.float32)
        dh = np.zeros_like(trace[0][0])
        for t in range(len(trace) - 1, -1, -1):
            before, z, r, q, k, _ = trace[t]
            dh = dh + dh_out[t]
            dk = dh * (1 - z) * (1 - k * k)
            dz = dh * (before - k) * z * (1 - z)
            dr = dk * q * r * (1 - r)
            da = np.concatenate([dz, dr, dk], axis=1)
            dg = np.concatenate([dz, dr, dk * r], axis=1)
            np.add.at(dx, data[t], da)
            du += before.T @ dg
            dc += dg[:, 2 * h_size :].sum(axis=0)
            dh = dh * z + dg @ u.T
        grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"] = dx, du, dc

    def loss(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over every position of full segments (time x batch) and its gradients."""
        steps, n = data.shape
        tf, tb = self._run("f", data), self._run("b", data[::-1])
        hf, hb = np.stack([s[5] for s in tf]), np.stack([s[5] for s in tb])[::-1]
        p = _softmax(hf @ self.w["of"] + hb @ self.w["ob"] + self.w["bias"])
        value = -float(np.log(np.take_along_axis(p, np.broadcast_to(target[None, :, None], (steps, n, 1)), axis=2) + 1e-9).mean())
        p[:, np.arange(n), target] -= 1
        p /= steps * n
        grads = {"bias": p.sum(axis=(0, 1))}
        for d, h in (("f", hf), ("b", hb)):
            grads[f"o{d}"] = np.tensordot(h, p, axes=((0, 1), (0, 1)))
        self._back("f", data, tf, p @ self.w["of"].T, grads)
        self._back("b", data[::-1], tb, (p @ self.w["ob"].T)[::-1], grads)
        return value, grads

    def fit(self, data: np.ndarray, target: np.ndarray, steps: int = 240, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches of full segments (rows of data)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(data), batch)
            value, grads = self.loss(data[pick].T, target[pick])
            losses.append(value)
            step = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            norm = max(1.0, float(np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
            for k, g in grads.items():
                g = g / norm
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = (self.w[k] - step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        return losses

    # Inference: features first, segments last, so that every gate is one contiguous block.

    def _scores(self, d: str, data: np.ndarray) -> np.ndarray:
        """The direction's share of the logits at every position: (time, languages, segments)."""
        h_size, (steps, n) = self.hidden, data.shape
        half = np.ones(3 * h_size, dtype=np.float32)
        half[: 2 * h_size] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        table = self.w[f"x{d}"] * half
        u = np.ascontiguousarray((self.w[f"u{d}"] * half).T)
        c = self.w[f"c{d}"][:, None]
        out = np.ascontiguousarray(self.w[f"o{d}"].T)
        h = np.zeros((h_size, n), dtype=np.float32)
        got = np.empty((steps, len(self.langs), n), dtype=np.float32)
        g = np.empty((3 * h_size, n), dtype=np.float32)
        for t in range(steps):
            a = np.ascontiguousarray(table[data[t]].T)
            np.matmul(u, h, out=g)
            zr = g[: 2 * h_size]
            zr += a[: 2 * h_size]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            k = g[2 * h_size :]
            k += c
            k *= zr[h_size:]
            k += a[2 * h_size :]
            np.tanh(k, out=k)
            h -= k
            h *= zr[:h_size]
            h += k
            np.matmul(out, h, out=got[t])
        return got

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of position probabilities (segments x languages); data is (segments, SEGMENT), zeros after each length."""
        steps = int(lengths.max())
        data = data[:, :steps]
        at = np.arange(steps)[:, None]
        full = bool((lengths == steps).all())
        mirror = np.broadcast_to(steps - 1 - at, (steps, len(data))) if full else np.maximum(lengths[None, :] - 1 - at, 0)
        ahead = self._scores("f", np.ascontiguousarray(data.T))
        back = self._scores("b", np.take_along_axis(data.T, mirror, axis=0))
        ahead += back[::-1] if full else np.take_along_axis(back, mirror[:, None, :], axis=0)
        ahead += self.w["bias"][:, None]
        ahead -= ahead.max(axis=1, keepdims=True)
        np.exp(ahead, out=ahead)
        ahead /= ahead.sum(axis=1, keepdims=True)
        if not full:
            ahead *= at[:, :, None] < lengths[None, None, :]
        return ahead.sum(axis=0).T

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities of each text, over all its bytes; zeros for an empty one."""
        owner, lengths, parts = [], [], []
        for i, b in enumerate(texts):
            for k in range(0, len(b), SEGMENT):
                owner.append(i)
                lengths.append(min(SEGMENT, len(b) - k))
            parts.append(b + bytes(-len(b) % SEGMENT))
        out = np.zeros((len(texts), len(self.langs)))
        if not owner:
            return out
        data = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, SEGMENT)
        lengths, owner = np.array(lengths), np.array(owner)
        order = np.argsort(-lengths, kind="stable")  # full segments together
        n_full = int((lengths == SEGMENT).sum())
        for a, b in [(i, min(i + _BATCH, n_full)) for i in range(0, n_full, _BATCH)] + [(i, min(i + _BATCH, len(order))) for i in range(n_full, len(order), _BATCH)]:
            pick = order[a:b]
            np.add.at(out, owner[pick], self.pooled(data[pick], lengths[pick]))
        return out / np.maximum([[len(b)] for b in texts], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def has_letter(text: str | None) -> bool:
    """Any character of the Unicode categories L*; superscripts, fractions and number forms are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def train(labelled: DataFrame, sample: int = 1500, per_document: int = 6, hidden: int = 8, steps: int = 240) -> Network | None:
    """Fits a network to the sample documents (text, lang) with the least hash, equal ones once.

    sample is the documented bound; per_document segments of SEGMENT bytes of each reach the driver. None where no
    labelled text has a letter.
    """

    def segments(text: str, h: int) -> bytes:
        if not has_letter(text):
            return b""
        b = text.encode("utf-8", "surrogatepass")
        b = b * (-(-SEGMENT // len(b))) if len(b) < SEGMENT else b
        at = np.random.default_rng(h).integers(0, len(b) - SEGMENT + 1, per_document if len(b) > SEGMENT else 1)
        return b"".join(b[k : k + SEGMENT] for k in at.tolist())

    rows = [r for r in draw(labelled.where("text is not null and lang is not null").select("text", "lang"), ["text", "lang"], sample, segments, ("lang",)) if r.blob]
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    data = [np.frombuffer(r.blob, dtype=np.uint8).reshape(-1, SEGMENT) for r in rows]
    target = np.repeat([langs.index(r.lang) for r in rows], [len(d) for d in data])
    network = Network(langs, hidden)
    network.fit(np.concatenate(data), target, steps=steps)
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the columns out to every row, in place of any of those names; no shuffle.

    und with score 0 where text is null, empty or has no letter, or where there is no network. Of languages that tie
    the first by name is taken. Rows that repeat stay repeated and have equal results; an empty table gives no rows.
    Texts run in slices of about 0.5 MB; a longer one makes a slice by itself, and its segments run 2048 at a time.
    """
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in out]

    def run(batches):
        keep_only()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices_of(texts, 1 << 19):
                part = texts.slice(a, b - a).to_pylist()
                known = [network is not None and has_letter(t) for t in part]
                p = network.documents([t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(part, known)]) if network else np.zeros((len(part), 1))
                best = p.argmax(axis=1)
                langs = [network.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known)]
                score = [min(1.0, max(0.0, float(p[i, k]))) if ok else 0.0 for i, (k, ok) in enumerate(zip(best.tolist(), known))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, *out])

    schema = docs.select(*keep).schema.add(out[0], "string").add(out[1], "double")
    return docs.select(*keep, F.col(text).cast("string").alias("__language_input")).mapInArrow(run, schema)
