"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, decontaminate, line_dedup, quality, similar
from tidewright.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the line labels reject go, null and empty texts among them; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of their source's pages go; documents stay, null texts as they are. n_chars stays the original's."""
    return line_dedup.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id (nulls last); several texts under one id are several documents."""
    return similar.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: token counts and digests of the ids and of the text they decode to; null texts are empty. Empty tables pass through all stages."""
    return bpe.digests(docs, bpe.SMALL_MEMO)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_boilerplate_lines),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("bpe encoding", bpe_encoding),
]

#: The quality model is trained and the tokenizer is a program: no SQL. Tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
