r"""Quality rules: exact counts, and a hashed n-gram logistic regression (operator 8).

Words are ``[^\x20\x09-\x0D]+`` of the whole text.  A document fails the base
rules with fewer than ``MIN_WORDS`` words or when more than half of its words
lie in 3-word windows that occur twice or more.  The others get the model's
verdict: word uni- and bigrams and character 2- to 4-grams, hashed, logistic
regression on labelled rows, Platt-calibrated on a fifth of the sample that
the regression did not see, against fixed probability thresholds.

Defined results: null and empty texts count nothing and fail the base rules;
a null doc_id passes through; repeated rows are scored each; ties do not
arise; other columns are ignored whatever their names; an empty table gives
an empty result; without labels of both kinds every document that passes the
base rules is kept with probability 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb
from tallywright.llm.linear import Ngrams, calibration_split, fit_linear, platt, sigmoid, stacked

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = tb.byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
FEATURES = Ngrams(words=(1, 2), chars=(2, 3, 4), slots=4096, lower=False)
#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 3000
#: Fixed threshold on the calibrated probability.
KEEP_AT = 0.5

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


@dataclass
class QualityModel:
    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(x))
        return sigmoid(self.slope * (x @ self.weights + self.bias).astype(np.float64) + self.offset)


def rule_counts(ch: tb.Chunk) -> dict[str, np.ndarray]:
    """The five counts of every text of a chunk."""
    s, e = ch.spans(tb.SPACE)
    off = ch.word_offsets(s)
    doc = tb.owner(off)
    lead = ~tb.CONTINUATION[ch.buf] & ~tb.SPACE[ch.buf]
    ls, le = ch.lines()
    has_word = np.searchsorted(s, le, "left") > np.searchsorted(s, ls, "left")
    ls, le = ls[has_word], le[has_word]
    line_doc = np.searchsorted(ch.offs, ls, "right") - 1
    key = tb.mix(ch.range_hash(ls, le, tb.BYTE_VALUE) + line_doc.astype(np.uint64) * tb.U64(tb.BASE))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(line_doc, minlength=ch.n) - np.bincount(line_doc[first], minlength=ch.n)
    win, woff = tb.shingles(ch.range_hash(s, e, tb.BYTE_VALUE), off, WINDOW, False)
    covered = np.zeros(len(s), bool)
    if len(win):
        wdoc = tb.owner(woff)
        key = tb.mix(win + wdoc.astype(np.uint64) * tb.U64(tb.BASE))
        order = np.argsort(key)
        sk = key[order]
        same = sk[1:] == sk[:-1]
        again = np.zeros(len(sk), bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]
        at = off[wdoc[at]] + at - woff[wdoc[at]]
        for j in range(WINDOW):
            covered[at + j] = True
    return {
        "n_words": np.diff(off),
        "word_chars": ch.per_text(lead),
        "n_symbols": ch.per_text(SYMBOLS[ch.buf]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(doc[covered], minlength=ch.n),
    }


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows (those with the smallest hash of doc_id), label column ``quality``; of rows with one doc_id that with the smallest features."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(b: pa.RecordBatch):
        ids, y = b.column(0).to_pylist(), b.column(2).to_pylist()
        for first, x in FEATURES.batches(b.column(1)):
            k = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + k], pa.int64()), pa.array(y[first : first + k], pa.int32()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = frames.map_arrow(rows, features, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    ids, y = (got[c].to_numpy().astype(np.int64) for c in ("doc_id", "y"))
    if len(set(y.tolist())) < 2:
        return QualityModel(None)
    cal = calibration_split(ids)
    if len(set(y[cal].tolist())) < 2 or len(set(y[~cal].tolist())) < 2:
        cal[:] = False
    # one matrix, training rows first: the driver holds nothing twice
    order = np.lexsort((ids, cal))
    x, y, k = stacked(got["x"], FEATURES.dim, order), y[order], int((~cal).sum())
    del got
    w, b = fit_linear(x[:k], y[:k], "log", 1e-5, 400)
    on = slice(k, None) if k < len(y) else slice(None)
    model = QualityModel(w, b, *platt(x[on] @ w + b, y[on]))
    del x
    frames.release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base verdict, probability and final verdict of every row; ``extra`` columns pass through."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts: dict[str, list] = {}
        for ch in tb.chunks(b.column(1)):
            for k, v in rule_counts(ch).items():
                parts.setdefault(k, []).append(v)
        prob = [model.probability(x) for _, x in FEATURES.batches(b.column(1))]
        counts = {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}
        p = np.concatenate(prob)
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
        cols = [b.column(0), *(pa.array(counts[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
        return pa.RecordBatch.from_arrays(cols + [b.column(2 + i) for i in range(len(extra))], names + list(extra))

    def guarded(b: pa.RecordBatch):
        return run(b) if b.num_rows else None

    src = docs.select(F.col("doc_id").cast("long"), "text", *extra)
    tail = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return frames.map_arrow(src, guarded, SCHEMA + tail)


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Fit on ``labels`` and score ``docs``."""
    return score(docs, fit(docs, labels, max_rows), keep_at)
