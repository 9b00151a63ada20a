"""Vectorised text primitives over the UTF-8 bytes of an Arrow string column.

Every operator that looks at words, lines or character n-grams shares this
module.  Texts are cut into chunks of about ``CHUNK`` bytes (a longer text is
a chunk of its own), so numpy temporaries stay a few tens of megabytes
whatever the Arrow batch size is.

Hashes are 64-bit: a prefix sum of per-byte random values times powers of an
odd base gives the hash of any byte range in O(1); ranges are then finalised
with a multiply-xorshift mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SHINGLE_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table, true on the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NON_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
CONTINUATION = byte_class((0x80, 0xBF))

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        with np.errstate(over="ignore"):
            for key, base in (("p", BASE), ("i", BASE_INV)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; bijective."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Chunk:
    """Some consecutive texts: ``rows`` in the batch, ``buf`` bytes, ``offs`` text bounds."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs = first, buf, offs
        self.n = len(offs) - 1
        self._prefix: dict[int, np.ndarray] = {}

    def prefix(self, values: np.ndarray) -> np.ndarray:
        key = id(values)
        if key not in self._prefix:
            p, _ = _power_table(len(self.buf) + 1)
            s = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(values[self.buf] * p[: len(self.buf)], out=s[1:])
            self._prefix[key] = s
        return self._prefix[key]

    def range_hash(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end) for each range; length-aware."""
        s = self.prefix(values)
        _, inv = _power_table(len(self.buf) + 1)
        return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(np.uint64))

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of non-separator bytes; texts never merge."""
        inside = ~separators[self.buf]
        n = len(inside)
        if not n:
            e = np.zeros(0, np.int64)
            return e, e
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def word_offsets(self, starts: np.ndarray) -> np.ndarray:
        """Bounds (n+1) of each text's words in ``starts``."""
        return np.searchsorted(starts, self.offs, "left")

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in ``mask``."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        r"""Starts and ends of the \n-split lines of every text (an empty text has one)."""
        nl = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offs[:-1], nl + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offs[1:], nl]), kind="stable")
        return starts, ends

    def text(self, k: int) -> str:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes().decode("utf-8", "replace")


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text index of every item, from (n+1) bounds."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def large_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Split a string column into :class:`Chunk` pieces of about ``size`` bytes."""
    arr = large_text(column)
    n = len(arr)
    if n == 0:
        return
    _, offbuf, data = arr.buffers()
    offs = np.frombuffer(offbuf, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def shingles(words: np.ndarray, offsets: np.ndarray, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their text bounds.

    With ``whole_if_short`` a text of 1..k-1 words has one window, its whole
    sequence; else it has none.
    """
    counts = np.diff(offsets)
    n_win = np.maximum(counts - k + 1, 0)
    if whole_if_short:
        n_win = np.where((counts > 0) & (counts < k), 1, n_win)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(n_win, out=out[1:])
    first = np.repeat(offsets[:-1] - out[:-1], n_win) + np.arange(out[-1])
    size = np.minimum(np.repeat(counts, n_win), k)
    acc = np.zeros(len(first), np.uint64)
    if len(first):
        last = len(words) - 1
        for j in range(k):
            w = words[np.minimum(first + j, last)] * SHINGLE_MULT[j]
            acc += np.where(j < size, w, U64(0)) if whole_if_short else w
    return mix(acc + size.astype(np.uint64)), out


def sum_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each [offsets[i], offsets[i+1])."""
    c = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def stable_hash(text: str, lower: bool = True) -> int:
    """The word hash that :meth:`Chunk.range_hash` gives this string."""
    raw = np.frombuffer(text.encode(), np.uint8)
    c = Chunk(0, raw, np.array([0, len(raw)]))
    return int(c.range_hash(np.array([0]), np.array([len(raw)]), LOWER_VALUE if lower else BYTE_VALUE)[0])
