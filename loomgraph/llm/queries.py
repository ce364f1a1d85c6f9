"""The registered queries of the corpus operators: opN_<name>, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, gif, licenses, mixing, oracle, quality_model, quality_rules, secrets, sharding, simhash, substrings
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1(table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op3(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(table(spark, sf_dir, "documents"))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.op5(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op8(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(table(spark, sf_dir, "documents"))


_ALL = (
    op1_simhash, op2_quality_model, op3_substrings, op4_mixing, op5_gif, op6_secrets, op7_quality_rules, op8_bpe,
    op9_sharding, op10_licenses,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """Fingerprints, tokens, media, models and cosines are beyond SQL; tests hold them against plain Python."""
    return {
        "op3_substrings": oracle.OP3, "op4_mixing": oracle.OP4, "op6_secrets": oracle.OP6, "op7_quality_rules": oracle.OP7,
    }
