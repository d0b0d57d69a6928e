"""The corpus pipeline: documents go through STAGES, each written as Parquet and read again.

Every stage but the last gives rows with the columns of documents. What a stage has written on its way, and
the stage before it, are deleted once the stage itself is written; the last one that is written, which the
result reads, goes when the driver's JVM ends.

Defined cases: null and empty texts have the same fingerprint, so that of all such documents one stays (a null
text as null), with no tokens; a text without a blank, or of any length, goes through whole; of repeated rows,
and of near copies, the one with the least doc_id stays (of equal ids and fingerprints the least row); rows
without a doc_id count as copies of rows with one, and one of several equal ones stays; without labels nothing
is toxic, without a benchmark nothing is contaminated; an empty table gives an empty result; further columns,
whatever their names, go along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, secrets, sentencepieces, simhash, toxicity
from weftline.llm.common import drop, save, table, temporary_tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.mild(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; the secrets in their texts are replaced."""
    return secrets.redacted(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token_ids."""
    return sentencepieces.encoded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("sentencepiece", as_pieces),
]
#: Training, fingerprints and merges can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with temporary_tables(spark, kept):
            kept.append(save(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        docs = kept[0]
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
