"""Operator 3 and the pipeline's near duplicates: near copies without an id, and very large sets."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tallywright.llm import jaccard_join
from tests.llm import helpers
from tests.llm.test_joins import brute_components, near


def test_near_copies_without_an_id(spark):
    r = random.Random(2)
    one, two = helpers.words(1, 120, 3000), helpers.words(2, 120, 3000)
    rows = [(5, " ".join(one)), (None, near(one, r, 1)), (None, near(one, r, 2)), (None, near(two, r, 1)), (None, " ".join(two)), (None, " ".join(two)), (9, " ".join(helpers.words(3, 80, 3000)))]
    docs = helpers.documents(spark, rows)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs).collect())
    assert got == brute_components(rows)
    assert [c for i, _, c in got.elements() if i is None].count(5) == 2
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter(rows)


def test_sets_with_cut_group_counts_still_pair():
    """Five million shingles in groups that each hold more than is counted: two members are compared entry by entry, 40 in a tree."""
    dims = jaccard_join.MOST_DIMS
    size = dims * (jaccard_join.FULL + 60)
    full = jaccard_join.point(np.repeat(np.arange(dims, dtype=np.uint64) << np.uint64(40), size // dims))
    assert (full == jaccard_join.FULL).all()
    for members in (2, 40):
        n = np.full(members, size)
        pts = jaccard_join.Points([full.tobytes()] * members)
        label = jaccard_join.candidate_labels(np.array([0, members]), n, pts, np.arange(members), np.zeros(members, np.int64), np.array([False]))
        assert not label.any()


def test_repeated_ids_are_dropped_by_row(spark):
    """Id 7 has a near copy of id 1 and a clean text, id 3 two near copies of one text; empty rows repeat."""
    r = random.Random(4)
    texts = [helpers.words(20 + k, 120, 3000) for k in range(3)]
    one, clean, two = (" ".join(t) for t in texts)
    rows = [(1, one), (7, near(texts[0], r, 1)), (7, clean), (3, two), (3, near(texts[2], r, 1)), (8, ""), (8, ""), (8, None)]
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, helpers.documents(spark, rows).repartition(3), "").collect())
    assert got[1, one] == got[7, clean] == got[8, ""] == got[8, None] == 1
    assert sum(n for (i, _), n in got.items() if i == 3) == 1 and sum(got.values()) == 5


def test_first_documents_keep_all_columns(spark):
    """Columns called like the operator's own stay as they are; empty tables stay empty."""
    r = random.Random(8)
    base = helpers.words(31, 100, 3000)
    rows = [(4, near(base, r, 1)), (2, " ".join(base)), (9, near(base, r, 2)), (None, " ".join(base)), (6, " ".join(helpers.words(32, 90, 3000))), (6, " ".join(helpers.words(32, 90, 3000)))]
    docs = helpers.documents(spark, rows).withColumnRenamed("lang", "comp").withColumnRenamed("source", "word")
    got = jaccard_join.first_documents(docs)
    assert got.columns == docs.columns
    assert Counter((x.doc_id, x.node, x.kept) for x in got.collect()) == Counter([(2, "x", 7), (None, "x", 7), (6, "x", 7)])
    assert jaccard_join.first_documents(docs.limit(0)).count() == 0
