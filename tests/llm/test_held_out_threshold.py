"""Operator 1: a language's threshold is the bare quantile of the perplexities of trusted rows that the model does not count."""

import math

from tallywright.llm import ngram_quality
from tests.llm import helpers
from tests.llm.test_joins import brute_kn, counted_ids


def quantile(values):
    return sorted(values)[math.ceil(ngram_quality.QUANTILE * len(values)) - 1]


def test_threshold_is_the_held_out_quantile(spark, monkeypatch):
    monkeypatch.setattr(ngram_quality, "LEAST_TRUSTED", 5)
    langs = ["en", "de", None]
    rows = [(i, " ".join(helpers.words(i, 40, 60 + 40 * (i % 3))), langs[i % 3]) for i in range(300)] + [(900, "und nur ein Wort", "xx")]
    ids = [i for i in range(300) if i % 4]
    counted, held = counted_ids(spark, ids)
    grams, p = brute_kn([t for i, t, _ in rows if i in counted], ngram_quality.ORDER)
    ppl = {i: math.exp(-sum(math.log(p(x)) for x in grams(t)) / len(grams(t))) for i, t, _ in rows}
    want = {lang: quantile([ppl[i] for i in held if langs[i % 3] == lang]) for lang in langs}
    every = quantile([ppl[i] for i in held])
    assert all(sum(langs[i % 3] == lang for i in held) >= 5 for lang in langs)
    got = ngram_quality.ngram_quality(helpers.documents(spark, rows).coalesce(2), spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    for r in got:
        limit = every if r.doc_id == 900 else want[langs[r.doc_id % 3]]
        assert math.isclose(r.threshold, limit, rel_tol=1e-4) and math.isclose(r.perplexity, ppl[r.doc_id], rel_tol=1e-4)
        assert r.kept == (r.perplexity <= r.threshold)
