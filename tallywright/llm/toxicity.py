"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Words of a clause become symbols (insult, threat, target, negation, reported
speech, other).  Five weighted transducers are composed, each reading what the
one before it puts out: reported speech and negation weaken insults and
threats in their scope, the threat transducer turns a threat that has a target
into a strike, the target transducer tells insults at a target from others,
and the insult transducer accepts the matches.  All weights stand on arcs; a
path's weight for a symbol is the product of its arcs, a clause's weight the
sum over the matches it puts out.  A document's score is a calibrated logistic
function of its matched clauses, not of isolated words.

The insult symbols are a short fixed list plus word beginnings (3 to 8 code
points) and whole words learned from labelled rows that are not held out: a
pattern is taken when so many toxic rows with different left neighbours, and
practically no others, have it that chance would give less than one such
pattern of its length.  Copies of one toxic text share their left neighbours
and so prove nothing.

Defined results: null and empty texts score the bias of the calibration
(below the threshold); a null doc_id is not held out; repeated rows are each
scored; an empty table gives an empty result; without labels the fixed list
and fixed coefficients are used; other columns are ignored whatever their
names.  Labels, lang, source and doc_id are not inputs of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import frames, textbatch as tb
from tallywright.llm.linear import fit_linear, platt, sigmoid

THRESHOLD = 0.7
#: Labelled rows (smallest hashes of doc_id) that lexicon and calibration are fitted on, at most.
TRAIN_ROWS = 20_000
#: A learned pattern's strength is half its log odds, within these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 6.0
PREFIXES = (3, 4, 5, 6, 7, 8)
WHOLE = 0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
INS, THR, TGT, NEG, REP, OTH = "insult", "threat", "target", "negation", "reported", "other"

#: Symbols of common English, French, German and Spanish words.
SEED_INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns imbecile scumbag vermin filth idiote crétin imbécile connard salaud ordure dummkopf trottel abschaum arschloch idiota estúpido imbécil basura escoria"
SEED_THREATS = "kill hurt destroy beat stab shoot burn punch murder strangle tuer frapper töten schlagen matar golpear"
SEED_TARGETS = "you your yours yourself he him she her they them their people u ur tu toi vous votre te du dich dir ihr euch sie tú usted vosotros ellos"
SEED_NEGATIONS = "not no never neither nor isn aren wasn don doesn didn cannot without ne pas jamais non sans nicht kein keine nie ohne nunca jamás sin"
SEED_REPORTED = "said says say saying quoted quote quotes claimed called reported wrote alleged according dit écrit selon cité sagte schrieb laut zitiert dijo escribió según citó"


# --- transducers ---------------------------------------------------------
#: Symbols between transducers: a weakened threat, an insult without and with a target, a target that comes after an insult, a threat with its target.
WEAK, HIT, AIMED, AIM, STRIKE, WEAK_STRIKE, MATCH = "weak threat", "hit", "aimed", "aim", "strike", "weak strike", "match"
NEGATED, REPORTED, WEAKENED = 0.3, 0.5, 0.4
TARGETED, THREATENED = 2.0, 2.5
NEGATION_SCOPE, REPORT_SCOPE = 3, 8


class Transducer:
    """Deterministic: (state, symbol) -> (state, output symbol, weight).

    A missing arc falls back to the state's ``*`` arc, which puts the symbol
    out as it is (or its own output, if it names one), and then to staying.
    """

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str) -> tuple:
        found = self.arcs.get((state, symbol))
        if found is None:
            state, out, weight = self.arcs.get((state, "*"), (state, None, 1.0))
            return state, symbol if out is None else out, weight
        return found


class Composed(Transducer):
    """The second transducer reads the first one's output; states are pairs, arcs are built as they are reached."""

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__((first.start, second.start), {})
        self.first, self.second = first, second

    def step(self, state, symbol: str) -> tuple:
        found = self.arcs.get((state, symbol))
        if found is None:
            a, middle, x = self.first.step(state[0], symbol)
            b, out, y = self.second.step(state[1], middle)
            found = self.arcs[state, symbol] = ((a, b), out, x * y)
        return found


def scope(trigger: str, length: int, insult: float) -> Transducer:
    """Within ``length`` symbols after a trigger insults weigh less and threats are weak; the state counts down."""
    arcs: dict = {}
    for k in range(length + 1):
        arcs[k, trigger] = (length, trigger, 1.0)
        arcs[k, "*"] = (max(0, k - 1), None, 1.0)
        if k:
            arcs[k, INS] = (k - 1, INS, insult)
            arcs[k, THR] = (k - 1, WEAK, 1.0)
    return Transducer(0, arcs)


def threat() -> Transducer:
    """A threat and a target, in any order, are a strike where the second of them stands; the state is what has been seen."""
    arcs: dict = {}
    for pending, strike in (("", None), (THR, STRIKE), (WEAK, WEAK_STRIKE)):
        arcs[(False, pending), TGT] = ((True, ""), strike or TGT, 1.0)
        arcs[(False, pending), THR] = ((False, THR), OTH, 1.0)
        arcs[(False, pending), WEAK] = ((False, pending or WEAK), OTH, 1.0)
    arcs[(True, ""), THR] = ((True, ""), STRIKE, 1.0)
    arcs[(True, ""), WEAK] = ((True, ""), WEAK_STRIKE, 1.0)
    return Transducer((False, ""), arcs)


def target() -> Transducer:
    """Insults after a target are aimed; a target after an insult is an aim.  States: 0 neither, 1 an insult, 2 a target."""
    arcs: dict = {(0, INS): (1, HIT, 1.0), (1, INS): (1, HIT, 1.0), (2, INS): (2, AIMED, 1.0), (0, TGT): (2, OTH, 1.0), (1, TGT): (2, AIM, 1.0), (2, TGT): (2, OTH, 1.0)}
    for k in (0, 1, 2):
        for x in (STRIKE, WEAK_STRIKE):
            arcs[k, x] = (2, x, 1.0)
    return Transducer(0, arcs)


def insult() -> Transducer:
    """Accepts the matches, with their weights; everything else puts out nothing."""
    out = {HIT: 1.0, AIMED: TARGETED, AIM: 1.0, STRIKE: THREATENED, WEAK_STRIKE: THREATENED * WEAKENED}
    return Transducer(0, {(0, "*"): (0, "", 0.0), **{(0, k): (0, MATCH, w) for k, w in out.items()}})


def grammar() -> Transducer:
    """reported speech o negation o threat o target o insult."""
    return reduce(Composed, (scope(REP, REPORT_SCOPE, REPORTED), scope(NEG, NEGATION_SCOPE, NEGATED), threat(), target(), insult()))


def clause_score(machine: Transducer, symbols: list[tuple[str, float]]) -> float:
    """The weight of one clause: of each match the arcs' weight times the symbol's own (an insult's strength, else 1); 0 if nothing matches."""
    state, total = machine.start, 0.0
    for symbol, strength in symbols:
        state, out, weight = machine.step(state, symbol)
        if out:
            total += weight * (strength if symbol == INS else 1.0)
    return total


# --- symbols of words ----------------------------------------------------
def folded(ch: tb.Chunk) -> tb.Chunk:
    """The chunk with A-Z and the two-byte letters of Latin-1 lower-cased."""
    buf = ch.buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] += 32
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][latin] += 32
    return tb.Chunk(ch.first, buf, ch.offs)


CLAUSE_END = tb.byte_class((10, 10), (33, 33), (46, 46), (59, 59), (63, 63))


class Lookup:
    """A bitmap, then a sorted table: weights of pattern hashes."""

    def __init__(self, weights: dict[int, float]):
        self.keys = np.array(sorted(weights), np.uint64)
        self.values = np.array([weights[int(k)] for k in self.keys])
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys & tb.U64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have a weight, and the weights."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(self.bits[(hashes & tb.U64(0xFFFF)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == hashes[at]
        return at[ok], self.values[k[ok]]


class Words:
    """Words of a folded chunk with their pattern hashes."""

    def __init__(self, ch: tb.Chunk):
        self.ch = folded(ch)
        self.starts, self.ends = self.ch.spans(tb.NON_ALNUM)
        self.offs = self.ch.word_offsets(self.starts)
        self.lead = np.append(np.flatnonzero(~tb.CONTINUATION[self.ch.buf]), len(self.ch.buf))
        self.first = np.searchsorted(self.lead, self.starts)
        self.chars = np.searchsorted(self.lead, self.ends) - self.first

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes and hashes of their first ``length`` characters (WHOLE: of the word)."""
        if length == WHOLE:
            at = np.arange(len(self.starts))
            h = self.ch.range_hash(self.starts, self.ends, tb.BYTE_VALUE)
        else:
            at = np.flatnonzero(self.chars > length)
            h = self.ch.range_hash(self.starts[at], self.lead[self.first[at] + length], tb.BYTE_VALUE)
        return at, tb.mix(h + tb.U64(length + 1))


def pattern_hash(word: str, length: int = WHOLE) -> int:
    h = np.array([tb.stable_hash(word, False)], np.uint64)
    return int(tb.mix(h + tb.U64(length + 1))[0])


@dataclass
class ToxicityModel:
    insults: dict[int, dict[int, float]]
    coef: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)
    bias: float = -4.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (x @ np.array(self.coef) + self.bias) + self.offset)


def seed_insults() -> dict[int, dict[int, float]]:
    return {WHOLE: {pattern_hash(w): 2.0 for w in SEED_INSULTS.split()}}


class Scorer:
    """Clause features of chunks; made once in each task."""

    def __init__(self, insults: dict[int, dict[int, float]]):
        self.insults = {n: Lookup(w) for n, w in insults.items() if w}
        others = {}
        for k, text in enumerate((SEED_THREATS, SEED_TARGETS, SEED_NEGATIONS, SEED_REPORTED)):
            others |= {pattern_hash(w): float(k) for w in text.split()}
        self.others = Lookup(others)
        self.machine = grammar()

    def features(self, ch: tb.Chunk) -> np.ndarray:
        """Per text: largest clause score, logs of their sum and number, and whether two or more core words match."""
        w = Words(ch)
        n = len(w.starts)
        weight = np.zeros(n)
        for length, lookup in self.insults.items():
            at, h = w.hashes(length)
            k, v = lookup.find(h)
            np.maximum.at(weight, at[k], v)
        at, h = w.hashes(WHOLE)
        k, kind = self.others.find(h)
        symbol = np.full(n, -1)
        symbol[k] = kind.astype(int)
        x = np.zeros((ch.n, 4))
        core = np.flatnonzero((weight > 0) | (symbol == 0))
        if not len(core):
            return x
        ends = np.zeros(len(w.ch.buf) + 1, np.int64)
        np.cumsum(CLAUSE_END[w.ch.buf], out=ends[1:])
        doc = tb.owner(w.offs)
        clause = ends[w.starts] + doc
        names = (THR, TGT, NEG, REP, OTH)
        hit = np.unique(clause[core])
        lo, hi = np.searchsorted(clause, hit, "left"), np.searchsorted(clause, hit, "right")
        for a, b in zip(lo.tolist(), hi.tolist()):
            score = clause_score(self.machine, [(INS, wt) if wt > 0 else (names[s], 0.0) for wt, s in zip(weight[a:b].tolist(), symbol[a:b].tolist())])
            if score > 0:
                d = doc[a]
                x[d, 3] += np.count_nonzero(weight[a:b]) + np.count_nonzero(symbol[a:b] == 0)
                x[d, 0] = max(x[d, 0], score)
                x[d, 1] += score
                x[d, 2] += 1
        x[:, 1:3] = np.log1p(x[:, 1:3])
        x[:, 3] = x[:, 3] >= 2
        x[:, 0] = np.minimum(x[:, 0], 20)
        return x


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    good = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~frames.held_out(F.col("doc_id")))
    chosen = good.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_insults(rows: DataFrame) -> dict[int, dict[int, float]]:
    """Patterns that mark toxic rows; ``rows`` is the bounded sample with label y."""

    def counts(b: pa.RecordBatch):
        y = np.array(b.column(2).to_pylist(), np.int64)
        for ch in tb.chunks(b.column(1)):
            w = Words(ch)
            doc = tb.owner(w.offs)
            for length in (WHOLE, *PREFIXES):
                at, h = w.hashes(length)
                key = np.unique(np.stack([h, doc[at].astype(np.uint64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                u, inv = np.unique(key[:, 0], return_inverse=True)
                toxic = y[ch.first + key[:, 1].astype(np.int64)] > 0
                t, o = np.bincount(inv[toxic], minlength=len(u)), np.bincount(inv[~toxic], minlength=len(u))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), length, np.int32)), pa.array(u.view(np.int64)), pa.array(t), pa.array(o)], ["length", "h", "t", "o"])

    per = frames.map_arrow(rows, counts, "length int, h long, t long, o long").groupBy("length", "h").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    n = {1: 0, 0: 0}
    for r in rows.groupBy((F.col("y") > 0).alias("p")).count().collect():
        n[int(r["p"])] = r["count"]
    if not n[0] or not n[1]:
        return {}
    per = frames.checkpointed(per.where("t + o >= 2"))
    kinds = {r["length"]: r["count"] for r in per.groupBy("length").count().collect()}
    rate = n[1] / (n[0] + n[1])
    least = {k: max(3, math.ceil(math.log(max(c, 2)) / -math.log(rate))) for k, c in kinds.items()}
    need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    cand = per.where((F.col("t") >= need[F.col("length")]) & (F.col("o") <= 0.02 * F.col("t")))
    # bounded by the sample: each candidate stands in three of its toxic rows or more
    cand = cand.collect()
    if not cand:
        return {}
    tables = {k: Lookup({r["h"] & (2**64 - 1): 1.0 for r in cand if r["length"] == k}) for k in kinds}

    def contexts(b: pa.RecordBatch):
        toxic = np.array(b.column(2).to_pylist(), np.int64) > 0
        for ch in tb.chunks(b.column(1)):
            w = Words(ch)
            _, whole = w.hashes(WHOLE)
            doc = tb.owner(w.offs)
            for length, lookup in tables.items():
                at, h = w.hashes(length)
                k, _ = lookup.find(h)
                k = k[toxic[ch.first + doc[at[k]]]]
                left = np.where(at[k] > w.offs[doc[at[k]]], whole[at[k] - 1], tb.U64(0))
                pairs = np.unique(np.stack([h[k], left], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), length, np.int32)), pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["length", "h", "l"])

    ctx = frames.map_arrow(rows, contexts, "length int, h long, l long").groupBy("length", "h").agg(F.count_distinct("l").alias("c"))
    ctx = {(r["length"], r["h"]): r["c"] for r in ctx.collect()}
    out: dict[int, dict[int, float]] = {}
    for r in cand:
        evidence = min(r["t"], ctx.get((r["length"], r["h"]), 0))
        if evidence >= least[r["length"]]:
            odds = math.log((evidence + 0.5) / (n[1] + 1)) - math.log((r["o"] + 0.5) / (n[0] + 1))
            out.setdefault(r["length"], {})[r["h"] & (2**64 - 1)] = float(min(MOST_STRENGTH, max(LEAST_STRENGTH, odds / 2)))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from labelled rows that are not held out: insults from three quarters, the calibration from the rest."""
    rows = _sample(docs, labels, max_rows)
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    insults = seed_insults()
    for length, more in learn_insults(rows.where(~calibrate)).items():
        insults.setdefault(length, {}).update(more)

    def features(b: pa.RecordBatch):
        scorer = Scorer(insults)
        for ch in tb.chunks(b.column(1)):
            x = scorer.features(ch)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(ch.first, ch.n), b.column(2).slice(ch.first, ch.n), *(pa.array(x[:, i]) for i in range(4))], ["doc_id", "y", *"abcd"])

    got = frames.map_arrow(rows.where(calibrate), features, "doc_id long, y int, a double, b double, c double, d double").toArrow()
    y = np.array(got["y"].to_pylist(), np.int64)
    if len(set((y > 0).tolist())) < 2:
        return ToxicityModel(insults)
    x = np.stack([got[c].to_numpy() for c in "abcd"], 1)
    w, b = fit_linear(x, (y > 0).astype(int), "log", 1e-4, 800)
    w = np.maximum(w, 0) if (w > 0).any() else np.ones(4, np.float32)  # more matches never lower a score
    slope, offset = platt(x @ w + b, y)
    frames.release(docs.sparkSession)
    return ToxicityModel(insults, tuple(float(v) for v in w), b, slope, offset)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """Score and verdict of every row; ``extra`` columns pass through."""

    def run(b: pa.RecordBatch):
        if not b.num_rows:
            return None
        scorer = Scorer(model.insults)
        p = model.probability(np.concatenate([scorer.features(ch) for ch in tb.chunks(b.column(1))]))
        cols = [b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols + [b.column(3 + i) for i in range(len(extra))], ["doc_id", "held_out", "score", "predicted", *extra])

    src = docs.select(F.col("doc_id").cast("long"), "text", frames.held_out(F.col("doc_id")).alias("held_out"), *extra)
    tail = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return frames.map_arrow(src, run, SCHEMA + tail)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows), threshold)
