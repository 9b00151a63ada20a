"""Hashed n-gram features and small linear models, fitted on the driver over a bounded sample.

The same featuriser runs in training and scoring, on Arrow batches, so a
model is a few dense weight vectors that travel in the task closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallywright.llm import textbatch as tb


@dataclass(frozen=True)
class Ngrams:
    """Which n-grams are hashed, and into how many slots per kind."""

    words: tuple[int, ...] = ()
    chars: tuple[int, ...] = ()
    slots: int = 4096
    lower: bool = True

    @property
    def dim(self) -> int:
        return self.slots * (bool(self.words) + bool(self.chars))

    def matrix(self, ch: tb.Chunk) -> np.ndarray:
        """One row per text: square roots of relative n-gram frequencies, a block for each kind.

        A text without n-grams of a kind has zeros in that block.  Characters
        are code points, found by the lead bytes.
        """
        values = tb.LOWER_VALUE if self.lower else tb.BYTE_VALUE
        blocks = []
        if self.words:
            s, e = ch.spans(tb.SPACE)
            off = ch.word_offsets(s)
            hashes = ch.range_hash(s, e, values)
            blocks.append(self._counts([tb.shingles(hashes, off, k, False) for k in self.words], ch.n))
        if self.chars:
            lead = np.append(np.flatnonzero(~tb.CONTINUATION[ch.buf]), len(ch.buf))
            off = np.searchsorted(lead[:-1], ch.offs, "left")
            grams = []
            for k in self.chars:
                n = np.maximum(np.diff(off) - k + 1, 0)
                o = np.zeros(len(off), np.int64)
                np.cumsum(n, out=o[1:])
                first = np.repeat(off[:-1] - o[:-1], n) + np.arange(o[-1])
                grams.append((ch.range_hash(lead[first], lead[first + k], values), o))
            blocks.append(self._counts(grams, ch.n))
        return np.concatenate(blocks, 1) if blocks else np.zeros((ch.n, 0), np.float32)

    def _counts(self, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total = np.zeros(n * self.slots, np.int64)
        for h, off in grams:
            slot = (h % np.uint64(self.slots)).astype(np.int64)
            total += np.bincount(tb.owner(off) * self.slots + slot, minlength=n * self.slots)
        x = total.reshape(n, self.slots).astype(np.float32)
        x /= np.maximum(x.sum(1, keepdims=True), 1)
        return np.sqrt(x)

    def batches(self, column: pa.Array):
        """(first row, matrix) pieces of at most 256 texts each."""
        for ch in tb.chunks(column):
            for a in range(0, ch.n, 256):
                b = min(a + 256, ch.n)
                part = tb.Chunk(ch.first + a, ch.buf[ch.offs[a] : ch.offs[b]], ch.offs[a : b + 1] - ch.offs[a])
                yield part.first, self.matrix(part)


def stacked(column: pa.ChunkedArray, dim: int, order: np.ndarray) -> np.ndarray:
    """Rows of float16 bytes as one float32 matrix, in the given order of rows; nothing else is copied."""
    out = np.empty((len(order), dim), np.float32)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a = 0
    for part in column.chunks:
        if not len(part):
            continue
        _, offs, data = part.buffers()
        first = int(np.frombuffer(offs, np.int32)[part.offset])
        rows = np.frombuffer(data, np.float16, len(part) * dim, first).reshape(-1, dim)
        out[place[a : a + len(part)]] = rows
        a += len(part)
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_linear(x: np.ndarray, y: np.ndarray, loss: str = "log", l2: float = 1e-4, steps: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent for logistic ("log") or squared-hinge SVM ("hinge") loss.

    ``y`` holds 0/1.  Deterministic: no random order, start at zero.
    """
    x = x.astype(np.float32, copy=False)
    sign = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    wt = np.ones(len(y), np.float32) if weight is None else weight.astype(np.float32)
    wt = wt / max(wt.sum(), 1e-9)
    v = np.ones(x.shape[1], np.float32)
    norm = 1.0
    for _ in range(12):
        v = x.T @ (wt * (x @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1.0 / ((0.25 if loss == "log" else 2.0) * (norm + 1.0) + l2)
    w = z = np.zeros(x.shape[1], np.float32)
    b = c = 0.0
    t = 1.0
    for _ in range(steps):
        m = sign * (x @ z + np.float32(c))
        g = -sign * sigmoid(-m) if loss == "log" else -2.0 * sign * np.maximum(1 - m, 0)
        g = (g * wt).astype(np.float32)
        w2 = z - np.float32(step) * (x.T @ g + np.float32(l2) * z)
        b2 = c - step * float(g.sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = w2 + np.float32((t - 1) / t2) * (w2 - w)
        c = b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, on smoothed targets."""
    margin = np.asarray(margin, np.float64)
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * margin + b)
        g = p - t
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margin**2).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def calibration_split(keys: np.ndarray) -> np.ndarray:
    """About a fifth of the sample, chosen by key, on which margins are calibrated."""
    return tb.mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
