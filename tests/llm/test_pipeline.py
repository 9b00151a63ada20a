"""The pipeline's stages on their own input, and its whole run, against the operators' plain results."""

import random

import pytest

import corpus_pipeline
from tallywright.llm import queries
from tests.llm import helpers
from tests.llm.test_joins import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    d = str(tmp_path_factory.mktemp("corpus"))
    item = helpers.words(4242, 30, 9000)
    rows, labels = [], []
    for i in range(150):
        w = helpers.words(i, r.randrange(60, 120), 4000)
        bad, toxic = i % 10 == 0, i % 10 == 1
        if bad:
            w = [x + r.choice(["***", "&&&"]) for x in w]
        if toxic:
            w = [*w[:10], "you", "idiot", *w[10:20], "pathetic", "loser", *w[20:]]
        if i % 10 == 2:
            w += item
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(500 + i, rows[3 + 10 * i][1] + " tail", "en", "s", 1) for i in range(10)]
    rows += [(600, None, None, None, None), (None, rows[4][1][::-1], "en", "s", 1), (700, rows[5][1][::-1], "en", "s", 1), (700, rows[5][1][::-1], "en", "s", 1)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), helpers.SCHEMA)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(after) <= set(before)
        gone = {i for i, _ in before} - {i for i, _ in after}
        sizes.append(len(after))
        if name == "quality_rules":
            assert gone == {*range(0, 150, 10), 600}
        elif name == "toxicity":
            assert gone == set(range(1, 150, 10))
        elif name == "near_duplicates":
            assert gone == set(range(500, 510)) and sum(i == 700 for i, _ in after) == 1
            assert {(i, c) for i, _, c in brute_components(after)} == {(i, i) for i, _ in after}
        else:
            assert gone == set(range(2, 150, 10))
    assert sizes == sorted(sizes, reverse=True)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run_equals_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in out}
    assert ids == {i for i in range(150) if i % 10 > 2} | {None, 700}


def test_registry():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
