"""The queries over this subpackage's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, licenses, pii, quality, secrets, sentencepieces, simhash, token_counts, toxicity, urls
from weftline.llm.common import table
from weftline.llm.quality_sql import quality_sql


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = sentencepieces.MODEL) -> DataFrame:
    """model: the path of a vocabulary file on the driver."""
    return sentencepieces.encoding_report(table(spark, sf_dir, "documents"), model)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = sentencepieces.MODEL) -> DataFrame:
    """model: the path of a vocabulary file on the driver."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OPERATORS = [
    op1_quality_rules, op2_pii, op3_secrets, op4_simhash, op5_url_filter, op6_sentencepiece, op7_decontamination, op8_token_counts, op9_licenses, op10_toxicity,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op2_pii": pii.pii_sql(), "op3_secrets": secrets.secret_sql()}
