"""Corpus pipeline: five operators of tallywright.llm in sequence over ``documents``.

1. quality_rules: rows that the quality rules reject go.
2. toxicity: rows with a toxicity score at or above the threshold go.
3. near_duplicates: of each group linked by 5-word shingle similarity of at
   least 0.75, one row with the smallest doc_id stays.  Texts without words
   link with nothing, of their exact repeats (id and text) one stays; rows
   with a null doc_id stay.
4. decontamination: rows that leak a benchmark item go.
5. best_fit_packing: token pieces of the kept rows, placed in sequences of
   1024 tokens.

Stages 1 to 4 return the columns of ``documents``.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import decontaminate, frames, jaccard_join, packing, quality_rules, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = frames.table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labels)
    return quality_rules.score(docs, model, extra=REST).where("kept").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = frames.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, extra=REST).where("predicted = 0").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_documents(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), frames.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifiers and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's docs."""
    docs = frames.table(spark, sf_dir, "documents")
    folder = frames.new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = frames.written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        frames.release(spark)
        if k:
            frames.drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
