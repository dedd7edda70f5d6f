"""The ten queries over whole tables, the pipeline, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, media, packing, pii, quality, records, secrets, simhash, warc

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), WORD_BPE)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(_table(spark, sf_dir, "documents"))


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"), BYTE_BPE, 2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe_round_trip, op2_media_columns, op3_best_fit_packing, op4_personal_data, op5_warc_archives, op6_simhash_components, op7_quality_scores, op8_exact_duplicates, op9_secret_scan, op10_token_records, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        h AS (SELECT payload_digest, min(page_id) AS head FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN h.head < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN h.head < d.page_id THEN h.head END AS refers_to
        FROM d LEFT JOIN h USING (payload_digest)
    """,
    "op8_exact_duplicates": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text)
    """,
}
