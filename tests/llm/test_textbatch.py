import random

import numpy as np
import pyarrow as pa
from tests.llm import helpers

from tallywright.llm import textbatch as tb


def texts():
    r = random.Random(1)
    alphabet = "ab \n\té中|#."
    return ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(300)] + [None]


def test_words_lines_and_hashes_match_python():
    rows = texts()
    for size in (50, 1000, 1 << 20):
        for ch in tb.chunks(pa.array(rows), size):
            s, e = ch.spans(tb.SPACE)
            off = ch.word_offsets(s)
            h = ch.range_hash(s, e, tb.BYTE_VALUE)
            ls, le = ch.lines()
            assert [ch.buf[a:b].tobytes().decode() for a, b in zip(ls, le)] == [x for k in range(ch.n) for x in (rows[ch.first + k] or "").split("\n")]
            for k in range(ch.n):
                want = helpers.SPACE.findall(rows[ch.first + k] or "")
                assert [ch.buf[a:b].tobytes().decode() for a, b in zip(s[off[k] : off[k + 1]], e[off[k] : off[k + 1]])] == want
                assert [tb.stable_hash(w, False) for w in want] == [int(x) for x in h[off[k] : off[k + 1]]]


def test_shingles_of_short_texts():
    w = np.arange(1, 8, dtype=np.uint64)
    h, off = tb.shingles(w, np.array([0, 0, 3, 7]), 3)
    assert off.tolist() == [0, 0, 1, 3]
    h2, off2 = tb.shingles(w[:2], np.array([0, 2]), 3)
    assert off2.tolist() == [0, 1] and h2[0] not in h
    assert tb.shingles(w[:2], np.array([0, 2]), 3, False)[1].tolist() == [0, 0]
