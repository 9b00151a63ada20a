"""Hierarchical language identification (operator 7).

First a one-versus-rest linear SVM picks the language family, then
one-versus-one linear SVMs separate the languages of that family; each
machine's margin is Platt-calibrated on a fifth of the sample.  Features are
hashed character 1- to 3-grams of the lower-cased (A-Z) text.

Defined results: ``und`` with score 0 for null texts and texts without a
letter (Unicode); a null doc_id is trained on as not held out; with one
learned language every text with a letter gets it, with score 1; with none,
``und``.  Repeated rows each get a result, an empty table an empty one, other
columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb
from tallywright.llm.linear import Ngrams, calibration_split, fit_linear, platt, sigmoid, stacked

FEATURES = Ngrams(chars=(1, 2, 3), slots=4096)
#: Training rows for each language, at most.
ROWS_PER_LANGUAGE = 800
SALTS = 64
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: ISO 639-1 codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return FAMILY_OF.get(code, f"own:{lang}")


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ self.weights + self.bias).astype(np.float64) + self.offset)


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family: list[Machine] = field(default_factory=list)
    pair: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every row of features."""
        n = len(x)
        if not self.families:
            return np.full(n, "und", object), np.zeros(n)
        if len(self.families) == 1:
            best, fp = np.zeros(n, int), np.ones(n)
        else:
            p = np.stack([m.probability(x) for m in self.family], 1)
            p /= np.maximum(p.sum(1, keepdims=True), 1e-12)
            best = p.argmax(1)
            fp = p[np.arange(n), best]
        lang, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.members[name]
            if not len(rows):
                continue
            if len(langs) == 1:
                lang[rows], score[rows] = langs[0], fp[rows]
                continue
            votes, strength = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                q = self.pair[langs[i], langs[j]].probability(x[rows])
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                strength[:, i] += q
                strength[:, j] += 1 - q
            pick = (votes + strength / (len(langs) + 1)).argmax(1)
            lang[rows] = np.array(langs, object)[pick]
            score[rows] = fp[rows] * strength[np.arange(len(rows)), pick] / (len(langs) - 1)
        return lang, np.clip(score, 0, 1)


def _machine(x: np.ndarray, y: np.ndarray, cal: np.ndarray) -> Machine:
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    if len(set(y[cal].tolist())) < 2 or len(set(y[~cal].tolist())) < 2:
        cal = np.zeros(len(y), bool)
    w, b = fit_linear(x[~cal], y[~cal], "hinge", 1e-4, 250, weight[~cal])
    on = cal if cal.any() else ~cal
    return Machine(w, b, *platt(x[on] @ w + b, y[on]))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows that are not held out; of each language the rows with the smallest hashes of doc_id.

    The choice ranks within (language, salt) first, so a language with most rows
    is spread over ``SALTS`` tasks that see ids and languages only, and then
    among what is left of each language, ``SALTS`` times its rows at most.
    """
    ids = docs.where(~frames.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    key = F.xxhash64("doc_id")
    some, own = (Window.partitionBy(*by).orderBy("key", "doc_id") for by in (("lang", "salt"), ("lang",)))
    chosen = ids.dropDuplicates(["doc_id", "lang"]).withColumn("key", key).withColumn("salt", F.pmod(key, F.lit(SALTS)))
    chosen = chosen.withColumn("r", F.row_number().over(some)).where(F.col("r") <= rows_per_language)
    chosen = chosen.withColumn("r", F.row_number().over(own)).where(F.col("r") <= rows_per_language).select("doc_id", F.col("lang").alias("y"))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").where(F.col("lang") == F.col("y")).select("doc_id", "text", "lang")

    def features(b: pa.RecordBatch):
        for first, x in FEATURES.batches(b.column(1)):
            k = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, k), b.column(2).slice(first, k), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    got = frames.map_arrow(rows, features, "doc_id long, lang string, x binary").toArrow()
    if not got.num_rows:
        return LanguageModel()
    ids, lang = got["doc_id"].to_numpy(), np.array(got["lang"].to_pylist(), object)
    order = np.lexsort((lang.astype(str), ids))
    x, lang, cal = stacked(got["x"], FEATURES.dim, order), lang[order], calibration_split(ids[order])
    del got
    model = LanguageModel()
    for code in sorted(set(lang)):
        model.members.setdefault(family_of(code), []).append(code)
    model.families = sorted(model.members)
    fam = np.array([family_of(v) for v in lang], object)
    if len(model.families) > 1:
        model.family = [_machine(x, (fam == f).astype(int), cal) for f in model.families]
    for langs in model.members.values():
        for a, b in combinations(langs, 2):
            at = (lang == a) | (lang == b)
            model.pair[a, b] = _machine(x[at], (lang[at] == a).astype(int), cal[at])
    del x
    frames.release(docs.sparkSession)
    return model


ASCII_LETTER = tb.byte_class((65, 90), (97, 122))


def has_letter(ch: tb.Chunk) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = ch.per_text(ASCII_LETTER[ch.buf]) > 0
    other = ch.per_text(ch.buf >= 0x80) > 0
    for k in np.flatnonzero(~found & other):
        found[k] = any(c.isalpha() for c in ch.text(int(k)))
    return found


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Predicted language and score of every row."""

    def run(b: pa.RecordBatch):
        if not b.num_rows:
            return None
        letter = np.concatenate([has_letter(ch) for ch in tb.chunks(b.column(1))])
        got = [model.predict(x) for _, x in FEATURES.batches(b.column(1))]
        lang, score = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        lang[~letter], score[~letter] = "und", 0.0
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return frames.map_arrow(docs.select(F.col("doc_id").cast("long"), "text", frames.held_out(F.col("doc_id")).alias("held_out")), run, SCHEMA)


def language_id(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    return identify(docs, fit(docs, rows_per_language))
