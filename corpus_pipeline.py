"""From raw documents to packed token sequences: quality, line dedup, near-dedup, personal data, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicledger.llm import line_dedup, near_dedup, packing, pii, quality
from civicledger.llm.common import documents, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the rated ones, does not call poor or toxic."""
    return quality.select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without long lines that many of them share."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024."""
    return packing.pack(docs)


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies),
          ("pii", mask_personal_data), ("packing", pack_sequences)]

ORACLE_SQL = None       # a trained classifier and a tokenizer are beyond SQL; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
