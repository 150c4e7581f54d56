"""One registered query per operator, and the pipeline, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import bin_swaps, importance, licenses, line_dedup, materialise, mixing, near_dedup, neighbours, oracles, packing, pages, quality, repair, substring_dedup
from skysift.session import TableStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op12_importance": oracles.OP12_IMPORTANCE, "op13_repair": oracles.OP13_REPAIR}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """Path of the vocabulary file; $VOCABULARY_FILE names another one."""
    named = os.environ.get("VOCABULARY_FILE")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    """Path of the byte-level vocabulary file; $BYTE_VOCABULARY_FILE names another one."""
    named = os.environ.get("BYTE_VOCABULARY_FILE")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.shares(table(spark, sf_dir, "documents"), TableStore(spark))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op3_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards and reads them again: every slot with its place and the checksum of its ids."""
    path = materialise.write_shards(table(spark, sf_dir, "documents"), TableStore(spark), vocabulary())
    return materialise.read_shards(spark, path).select("slot", "shard", "byte_offset", F.crc32("ids").alias("ids_crc32"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), TableStore(spark))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents"), TableStore(spark))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), TableStore(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), TableStore(spark))


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), TableStore(spark), F.col("vec_id") % 100 == 0)


@query
def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"), TableStore(spark))


@query
def op11_bin_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_swaps.pack(table(spark, sf_dir, "documents"), byte_vocabulary(), TableStore(spark))


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TableStore(spark))


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damaged(conversations), TableStore(spark))
