"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Stages but the last return all columns of what they are given, whatever their names, and take
empty tables (result: empty), null and empty texts (alike but kept apart where a text is
returned), very long texts (whole), repeated rows and null ids as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import exact, packing, quality, secrets, simhash
from meshlark.llm.common import shared_folder
from meshlark.llm.queries import WORD_BPE


#: Rows of an Arrow batch in this program: workers serve all stages in turn, and what each has held adds up.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's bound on rows of a batch, unless it is lower already; Spark bounds a batch's bytes by itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; documents that it rejects go.

    Rows of equal texts share their fate, repeated rows included; null text is judged as empty text;
    a null id is judged but teaches nothing; without labels every row stays.
    """
    small_batches(spark)
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text equals empty text; of repeated rows one stays; a null id is the smallest, so such a row
    stays only if no other row has its text.
    """
    small_batches(spark)
    return exact.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest doc_id stays.

    Null, empty and blank texts are near-duplicates of each other; a tie of rows with the smallest
    doc_id and its component keeps them all; rows without an id stay.
    """
    small_batches(spark)
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    Overlapping finds become one mark; null text stays null; n_chars, if there, follows the text.
    """
    small_batches(spark)
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all documents.

    Null and empty text is the end id alone; repeated rows are pieces of their own; null ids stay null.
    """
    small_batches(spark)
    return packing.packed(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: trained scores, hashes of shingles and tokenising are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, with a written table in the shared folder between any two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
