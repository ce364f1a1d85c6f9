"""A training-data pipeline over the documents: each stage takes the table that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, mixing, quality_rules, secrets, simhash
from loomgraph.llm.common import Scratch, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets through."""
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash over shingles of five words, four bits, then the exact similarity."""
    return simhash.dedup(docs, shingle=5, radius=4)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    return secrets.redact(docs, length_col="n_chars")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shuffled order."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("byte-level BPE", encoded),
]

#: SQL can't express the links of near duplicates and the token ids; tests hold the near duplicates against plain Python with
#: exact Jaccard groups, and the other stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
