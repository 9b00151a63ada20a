"""Queries over the driver's tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import frames
from tallywright.llm.decontaminate import leaks
from tallywright.llm.jaccard_join import jaccard_components
from tallywright.llm.language_id import language_id
from tallywright.llm.licenses import license_scan
from tallywright.llm.ngram_quality import ngram_quality
from tallywright.llm.packing import best_fit_packing
from tallywright.llm.quality_rules import quality_rules
from tallywright.llm.token_files import read_token_files, write_token_files
from tallywright.llm.toxicity import toxicity
from tallywright.llm.warc import warc_round_trip


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = frames.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return ngram_quality(frames.table(spark, sf_dir, "documents"), trusted)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(frames.table(spark, sf_dir, "pages"), frames.new_folder(spark, "warc")).drop("uri")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(frames.table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = frames.new_folder(spark, "tokens")
    files = write_token_files(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, 49_408)
    return read_token_files(spark, files)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(frames.table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(frames.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(frames.table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_quality": op1_ngram_quality,
    "op2_warc": op2_warc,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM e JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r(doc_id, z) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.z FROM r JOIN (SELECT x AS a, y AS z FROM l UNION ALL SELECT y, x FROM l) b ON b.a = r.z)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(z) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
