"""Operators 4, 7, 8 and 10: against brute force, held-out accuracy and odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest

from tallywright.llm import language_id, licenses, quality_rules, toxicity
from tests.llm import helpers


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def brute_rules(t):
    t = t or ""
    w = helpers.SPACE.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if helpers.SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(160):
        body = helpers.words(i, r.randrange(60, 140))
        good = i % 4 != 0
        if not good:
            body = [w + r.choice(["***", "###", "&&&"]) for w in body]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                body.insert(r.randrange(len(body)), r.choice(["you idiot", "pathetic loser", "zorbique"]))
        rows.append((i, " ".join(body) + ("\nsame line\nsame line" if i % 7 == 0 else ""), None))
        labels.append((i, int(good), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_counts_and_verdicts(spark, corpus):
    rows, labels = corpus
    every = [*rows, *helpers.odd_rows()]
    got = quality_rules.quality_rules(helpers.documents(spark, every), labels).collect()
    assert len(got) == len(every)
    want = Counter((i, *brute_rules(t)) for i, t, *_ in every)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 160 and not r.base_failed:
            assert r.kept == (r.doc_id % 4 != 0)


def test_quality_without_labels_keeps_what_passes(spark):
    docs = helpers.documents(spark, [(1, " ".join(helpers.words(1, 80)))])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(docs, none).first().kept
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0


def test_toxicity_held_out(spark, corpus):
    rows, labels = corpus
    every = [*rows, *helpers.odd_rows()]
    got = toxicity.toxicity(helpers.documents(spark, every), labels).collect()
    assert len(got) == len(every)
    wrong = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 160:
            assert r.held_out == held_out(r.doc_id)
            wrong += r.predicted != int(r.doc_id % 5 == 1)
        elif r.doc_id is None:
            assert not r.held_out
    assert wrong <= 3


def test_toxicity_ignores_held_out_labels(spark, corpus):
    rows, labels = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = helpers.documents(spark, rows)
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b


def test_clause_grammar():
    m = toxicity.grammar()

    def score(*symbols):
        return toxicity.clause_score(m, [(s, 2.0 if s == toxicity.INS else 0.0) for s in symbols])

    I, T, N, R, O, H = toxicity.INS, toxicity.TGT, toxicity.NEG, toxicity.REP, toxicity.OTH, toxicity.THR
    assert score(T, O, I) > score(O, I) > score(N, I) > 0
    assert score(R, O, I) < score(O, I)
    assert score(N, O, O, O, I) == score(I)
    assert score(H) == 0 and score(H, T) > 0 and score(T, N, H) < score(T, H)
    assert score(O, T, N) == 0
    # arc weights: an aimed insult counts double, negated and reported ones in their shares, also together
    assert score(I) == 2 and score(T, I) == 4 and score(N, I) == 0.6 and score(R, O, N, I) == pytest.approx(2 * 0.5 * 0.3)
    assert score(H, T) == score(T, H) == 2.5 and score(N, H, T) == score(T, N, H) == pytest.approx(2.5 * 0.4)
    assert score(I, T) == 3 and score(H, T, I) == 2.5 + 4 and score(R, *[O] * 8, I) == score(I)


def test_each_transducer_reads_the_one_before():
    """Running the five in a chain by hand gives what the composition gives, on all short clauses."""
    import itertools

    parts = [toxicity.scope(toxicity.REP, 8, 0.5), toxicity.scope(toxicity.NEG, 3, 0.3), toxicity.threat(), toxicity.target(), toxicity.insult()]
    machine = toxicity.grammar()
    kinds = (toxicity.INS, toxicity.THR, toxicity.TGT, toxicity.NEG, toxicity.REP, toxicity.OTH)
    for clause in itertools.product(kinds, repeat=5):
        states, want = [p.start for p in parts], 0.0
        for symbol in clause:
            x, weight = symbol, 1.0
            for k, p in enumerate(parts):
                states[k], x, w = p.step(states[k], x)
                weight *= w
            want += weight * (1.5 if symbol == toxicity.INS else 1.0) if x else 0.0
        assert toxicity.clause_score(machine, [(s, 1.5) for s in clause]) == pytest.approx(want)


def test_language_id(spark):
    r = random.Random(2)
    parts = {"en": ["the", "ing", "th", "and"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "oir", "ent", "que"], "es": ["cion", "ado", "los", "que"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 4]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(60)), lang))
    every = [*rows, *helpers.odd_rows(), (20_000, "123 456 !!!")]
    got = language_id.language_id(helpers.documents(spark, every)).collect()
    assert len(got) == len(every)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(240) if held_out(i)]
    assert sum(by[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    for i in (10_000, 10_001, 10_002, 20_000):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[10_005].lang_pred != "und" and all(0 <= r.score <= 1 for r in got)
    empty = helpers.documents(spark, [(1, "abc", None)])
    assert language_id.language_id(empty).first().lang_pred == "und"


def brute_license(t):
    w = helpers.ALNUM.findall((t or "").translate(helpers.LOW))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def brute_spans(texts):
    """All template spans of every text, by trying every start."""
    words = [helpers.ALNUM.findall((t or "").translate(helpers.LOW)) for t in texts]
    forms = licenses.templates()
    df = Counter(w for ws in words for w in set(ws))
    weigh = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for t in forms for w in t.words}
    out = []
    for ws in words:
        found = []
        for t in forms:
            total, after = sum(weigh[w] for w in t.words), None
            for start in range(-len(t.words), len(ws)):
                if after is not None and start <= after:
                    continue
                shifts, shift = [], 0
                for k, (a, n) in enumerate(t.phrases):
                    places = [shift] if k == 0 else [shift + d for d in sorted(range(-licenses.SLACK, licenses.SLACK + 1), key=abs)]
                    hit = [x for x in places if start + a + x >= 0 and tuple(ws[start + a + x : start + a + x + n]) == t.words[a : a + n]]
                    if not hit:
                        break
                    # words before the first phrase go with it, others with the phrase before them
                    shift = hit[0]
                    shifts.append((a, shift))
                else:
                    cover = 0.0
                    for k, w in enumerate(t.words):
                        own = [x for a, x in shifts if a <= k]
                        at = start + k + (own[-1] if own else 0)
                        if 0 <= at < len(ws) and ws[at] == w:
                            cover += weigh[w]
                    if cover / total >= licenses.MIN_COVER:
                        found.append((t.label, start, len(t.words), round(cover / total, 6)))
                        after = start + licenses.SLACK
        out.append(sorted(found))
    return out


def test_license_spans_against_brute_force(spark):
    r = random.Random(12)
    full = [" ".join(t).replace("[", "").replace("]", "") for t in licenses.TEMPLATES.values()]
    rows = []
    for i in range(60):
        w = r.choice(full).split()
        for _ in range(r.randrange(5)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(["software", "license", "odd", "the"])]
        w = w[: r.randrange(1, len(w) + 1)] if i % 2 else w[r.randrange(len(w)) :]
        rows.append((i, " ".join([*helpers.words(i, r.randrange(20), 50), *w, *r.choice(full).split()[:20]])))
    every = [*rows, *helpers.odd_rows(long_words=3000)]
    want = Counter((i, tuple(s)) for (i, _), s in zip(every, brute_spans([t for _, t in every])))
    got = licenses.license_scan(helpers.documents(spark, every)).collect()
    found = Counter((g.doc_id, tuple(sorted((s.label, s.start, s.words, round(s.cover, 6)) for s in g.spans))) for g in got)
    assert found == want
    assert len({label for _, spans in want for label, *_ in spans}) > 12
    for g in got:
        assert set(filter(None, g.labels.split(","))) == {s.label for s in g.spans} | set(filter(None, g.base_labels.split(",")))


def test_license_scan(spark):
    notices = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. All rights reserved. All rights reserved.", "general public  license CC-BY", "the mit approach", "General Public Library license"]
    rows = [(i, " ".join(helpers.words(i, 30)) + "\n" + n + "\n" + " ".join(helpers.words(i + 50, 30))) for i, n in enumerate(notices)]
    every = [*rows, *helpers.odd_rows()]
    got = licenses.license_scan(helpers.documents(spark, every)).collect()
    want = Counter((i, *brute_license(t)) for i, t, *_ in every)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[0].labels == "mit" and by[1].labels == "gpl,gpl-3.0" and "cc-by-nc-4.0" in by[2].labels and "reserved" in by[2].labels
    assert by[4].labels == "" and by[4].score == 0 and by[5].labels == ""
    assert licenses.license_scan(helpers.documents(spark, rows).limit(0)).count() == 0
