"""From raw documents to tokens: quality rules, near-duplicates, decontamination, personal data, byte-pair encoding.

Every stage works on all that its predecessor kept and returns the columns of documents (the last one tokens). Stages
are written as Parquet in the shared folder and read again, so each survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, minhash, pii, quality_rules
from tessella.llm.common import read_table, staged

#: Least similarity of near-duplicates in hundredths; op6_minhash has a higher one of its own.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the current policy go."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents with a similarity of SIMILAR / 100 or more are linked."""
    return minhash.one_of_each(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the texts; n_chars, where there is one, stays that of the input."""
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text."""
    return bpe.encoded(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("tokens", tokens)]

#: SQL can't express the templates, the trained span classifier and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
