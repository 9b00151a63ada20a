"""Exact, cached tokenisation with the ``tokenizers`` library.

Both tokenizer files split text so that a token never spans certain places:
``word_bpe`` drops white space, ``byte_bpe`` starts a piece at a single space
between two non-space characters.  Texts are cut there, every distinct piece
of an Arrow batch goes through the library once, and the ids are gathered by
numpy.  A text whose pieces could interact (runs of spaces, other white space
at a piece's edge, NUL) goes through the library whole.

A piece that is one word of ASCII or Latin-1 letters needs no splitting: it
goes straight to the library's BPE model.  An encoder does so only if the
library's whole path gives the same ids for a list of probes.

The operators take the library as it is: the content of an added token
(``<|endoftext|>``) inside a text is that token's one id, and such a text goes
through the library whole.  ``encoder(path)`` without ``added`` splits it into
ordinary pieces instead.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallywright.llm import textbatch as tb

END_ID = 2
#: Distinct pieces that a task remembers, at most; the memory is emptied when full.
CACHE = 500_000
MARK = "\x00"
#: Pieces whose edge white space (Unicode) may join with a neighbour's.
ODD = r"^ [\t-\r\x1c-\x20\x{85}\p{Z}]|^[\t-\r\x1c-\x1f\x{85}]|^[^\P{Z} ]|^ $|[\t\x0b-\r\x1c-\x20\x{85}\p{Z}]$|[\t-\r\x1c-\x20\x{85}\p{Z}]\n$|^\n$"

_loaded: dict[tuple[str, bool], "Encoder"] = {}


LETTER = tb.byte_class((65, 90), (97, 122))
PUNCT = tb.byte_class((33, 47), (58, 64), (91, 96), (123, 126))
SOLID = tb.byte_class((33, 126))


WORD = re.compile(" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+")
PROBES = "a word Word É Été naïve ß straße Ünter øre".split() + [" a", " word", " Été", " straße", " strasse", " internationalisation", " Qzxj"]


def byte_letters() -> dict[int, int]:
    """The printable character that byte-level models have for each byte: itself, or one from 256 on in byte order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


def marked(arr: pa.Array) -> pa.Array:
    """The texts with MARK at places that no token spans.

    Those are: before a space; between a letter (ASCII or Latin-1) and ASCII
    punctuation; between a line feed after visible ASCII and an ASCII letter.
    """
    n = len(arr)
    _, offbuf, data = arr.buffers()
    offs = np.frombuffer(offbuf, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    cut = buf == 32
    if len(buf) > 2:
        letter = LETTER[buf]
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        before = letter.copy()
        before[1:] |= latin
        cut[1:] |= before[:-1] & PUNCT[buf[1:]]
        cut[2:] |= SOLID[buf[:-2]] & (buf[1:-1] == 10) & letter[2:]
    at = np.flatnonzero(cut)
    at = at[~np.isin(at, offs)] if len(at) and n > 1 else at[at > 0] if len(at) else at
    new = np.insert(buf, at, 0)
    moved = offs + np.searchsorted(at, offs, "left")
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(new))


class Encoder:
    """A tokenizer with a flat store of the ids of pieces it has seen."""

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added else []
        self.drops_space = self.tok.normalizer is not None
        self.bpe, self.letters = self.tok.model, byte_letters()
        self._empty()
        self.direct = False
        words = [p for p in PROBES if WORD.fullmatch(p)]
        self.direct = [self._word(p) for p in words] == [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _word(self, piece: str) -> list[int]:
        """The ids of one word of letters, with a space before it perhaps."""
        if self.drops_space:
            piece = piece.lstrip(" ").lower()
        return [t.id for t in self.bpe.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _places(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and number of ids of each piece in the store, and the store."""
        if len(self.known) > CACHE:
            self._empty()
        known, flat, ends = self.known, self.flat, self.ends
        new = [p for p in pieces if p not in known]
        if self.direct:
            rest = []
            for p in new:
                if not WORD.fullmatch(p):
                    rest.append(p)
                    continue
                known[p] = len(ends) - 1
                flat.extend(self._word(p))
                ends.append(len(flat))
            new = rest
        for a in range(0, len(new), 5000):
            part = new[a : a + 5000]
            for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[p] = len(ends) - 1
                flat.extend(e.ids)
                ends.append(len(flat))
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        ends = np.array(ends, np.int64)
        return ends[at], ends[at + 1] - ends[at], np.append(np.array(flat, np.uint32), np.uint32(END_ID))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), each text's end id included, and their bounds (n+1)."""
        arr = texts.fill_null("").cast(pa.large_string())
        n = len(arr)
        lists = pc.split_pattern(marked(arr), MARK)
        bounds = np.asarray(lists.offsets, np.int64)
        bounds = bounds - bounds[0]
        enc = lists.flatten().dictionary_encode()
        del lists
        codes = enc.indices.to_numpy(zero_copy_only=False)
        alone: dict[int, np.ndarray] = {}
        whole = np.asarray(pc.match_substring(arr, MARK))
        for content in self.added:
            whole = whole | np.asarray(pc.match_substring(arr, content))
        if not self.drops_space:
            odd = np.asarray(pc.match_substring_regex(enc.dictionary, ODD))
            if odd.any():
                whole = whole | (np.add.reduceat(np.append(odd[codes], False), bounds[:-1]) > 0)
        for k in np.flatnonzero(whole).tolist():
            alone[k] = np.array(self.tok.encode(arr[k].as_py(), add_special_tokens=False).ids, np.uint32)
        first, size, store = self._places(enc.dictionary.to_pylist())
        codes = np.insert(codes, bounds[1:], len(size))
        first, size = np.append(first, len(store) - 1)[codes], np.append(size, 1)[codes]
        ends = bounds[1:] + np.arange(1, n + 1)
        for k in alone:
            size[bounds[k] + k : ends[k] - 1] = 0
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        out = store[np.repeat(first - at[:-1], size) + np.arange(at[-1])]
        offs = np.concatenate([[0], at[ends]])
        if alone:
            parts = [out[offs[k] : offs[k + 1]] if k not in alone else np.append(alone[k], np.uint32(END_ID)) for k in range(n)]
            out = np.concatenate(parts)
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, offs.astype(np.int64)


def encoder(path: str, added: bool = False) -> Encoder:
    """The encoder of a tokenizer file, loaded once in each worker; with ``added``, added tokens in texts count."""
    if (path, added) not in _loaded:
        _loaded[path, added] = Encoder(path, added)
    return _loaded[path, added]


def slices(column: pa.Array, size: int = 4 << 20):
    """(first row, sub-array) pieces of about ``size`` bytes of text."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    cum = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        base = cum[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(cum, base + size, "right")))
        yield a, column.slice(a, b - a)
        a = b
