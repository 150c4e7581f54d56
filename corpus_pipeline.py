"""A training corpus from documents: quality, lines, near-duplicates, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import line_dedup, mixing, near_dedup, packing, quality
from skysift.llm.queries import vocabulary
from skysift.session import TableStore


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, TableStore(spark))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(docs, TableStore(spark)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, TableStore(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, TableStore(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

# Estimates, confirmations and byte-pair ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole corpus; every stage's result is written and read again."""
    store = TableStore(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
