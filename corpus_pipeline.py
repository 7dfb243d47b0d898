"""A corpus pipeline: each stage takes the documents that its predecessor kept and decides with one training-data operator.

Stages take nulls in any column, empty and very long texts, repeated rows and ids, empty tables and extra columns, which stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import decontaminate, lang_id, mixing, near_copies, secret_scan
from canopy.llm.common import staged, table

#: Rows, and bytes of them, that go to Python at once: with texts of some kilobytes, Spark's 10,000 would be tens of megabytes on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes in a batch, unless they are fewer already."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    if not 0 < int(spark.conf.get(_BYTES).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null texts, texts without a letter, long ones that no prototype is near; all, if nothing can be learned.

    Equal texts share their fate; a null lang isn't learned from.
    """
    bounded(spark)
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five-word Jaccard of at least 0.8), the one of smallest id.

    A null id counts as the largest; of repeated rows one stays.  All texts without words are copies of each other.
    """
    bounded(spark)
    return near_copies.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts, and such items, hold and match nothing."""
    bounded(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark and sets n_chars anew; null texts stay null, no row goes."""
    bounded(spark)
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by source, language and topic; a null is a value of its own, repeated ids share their fate."""
    bounded(spark)
    return mixing.sample_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("mixture", mixture)]

#: Learned prototypes, groups of near copies, hashed topics and raking are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
