"""Training-order materialisation: token sequences in shards of fixed stride, in keyed pseudo-random order.

Tasks tokenize their rows to one stream and cut it into sequences of `length`
ids, the last one of a task filled up. With the counts per task, a sequence has a
dense number; a keyed Feistel network walks that number through a domain of a
power of four until it falls below the number of sequences, which is its global slot:
a permutation that needs no shuffle of its own and no stored order. Rows go to
shards by slot; each shard is one file of records of equal size in slot order,
written by Spark's own writer and committed as a whole, so it survives lost executors.

A record is the ids as little-endian unsigned 16-bit numbers and one newline, so the
record of a slot begins at (slot mod shard_rows) * stride in the file of shard
slot div shard_rows, and reading goes on there after a break.

Defined results: a null or empty text is the end id alone; repeated rows are written
as often as they occur; padding is the end id; an empty table gives no shards.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.arrays import blocks, mix
from skysift.session import TableStore

LENGTH = 2048
END_ID = 2
SHARD_ROWS = 2048
ROUNDS = 6


def stride(length: int = LENGTH) -> int:
    return 2 * length + 1


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, text_col: str = "text") -> DataFrame:
    """part, number within it, n_tokens without padding, and the ids as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from skysift.llm.tokens import word_ids

        coder = word_ids(vocabulary)
        if len(coder.ends) > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit into 16 bits")
        part, number = TaskContext.get().partitionId(), 0
        rest = np.zeros(0, np.uint32)

        def out(ids: np.ndarray, n_tokens: list[int]) -> pa.RecordBatch:
            n, wide = len(n_tokens), ids.astype("<u2").tobytes()
            size = 2 * length
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([wide[k * size : (k + 1) * size] for k in range(n)], pa.binary())], names=["part", "number", "n_tokens", "ids"])

        for batch in batches:
            for _, _, buf, offs in blocks(batch.column(0)):
                rest = np.concatenate([rest, coder.encode(buf, offs, end_id)[0]])
                n = len(rest) // length
                if n:
                    yield out(rest[: n * length], [length] * n)
                    number += n
                    rest = rest[n * length :]
        if len(rest):
            yield out(np.concatenate([rest, np.full(length - len(rest), end_id, np.uint32)]), [len(rest)])

    return docs.select(docs[text_col].alias("text")).mapInArrow(work, "part long, number long, n_tokens long, ids binary")


def feistel(x: np.ndarray, half_bits: int, key: int) -> np.ndarray:
    """Keyed permutation of the numbers of 2 * half_bits bits."""
    mask = np.uint64((1 << half_bits) - 1)
    left, right = x >> np.uint64(half_bits), x & mask
    for r in range(ROUNDS):
        left, right = right, left ^ (mix(right + mix(np.full(1, (key * ROUNDS + r) % (1 << 64), np.uint64))) & mask)
    return (left << np.uint64(half_bits)) | right


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """A permutation of 0 .. total - 1, walked along its cycle in the larger domain."""
    half_bits = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    x = feistel(numbers.astype(np.uint64), half_bits, key)
    while (far := x >= np.uint64(total)).any():
        x[far] = feistel(x[far], half_bits, key)
    return x.astype(np.int64)


def write_shards(docs: DataFrame, store: TableStore, vocabulary: str, key: int = 11, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> str:
    """Write all sequences of `docs`; the folder has one file below each shard=<number>, and lengths as a table beside it."""
    tokenized = sequences(docs, vocabulary, length)
    # Ids of 16 bits hardly shrink under the default codec; this table lies on disk beside its shuffle and the shards.
    tokenized.write.mode("overwrite").option("compression", "zstd").parquet(store.path("sequences"))
    made = store.spark.read.schema(tokenized.schema).parquet(store.path("sequences"))
    counts = made.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.write(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    total = counts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(slots(numbers.to_numpy(), total, key))

    placed = made.join(parts, "part").withColumn("slot", slot(F.col("base") + F.col("number")))
    placed = placed.withColumn("shard", F.expr(f"slot div {shard_rows}"))
    n_shards = max(1, -(-total // shard_rows))
    record = F.concat("ids").cast("string").alias("record")
    path = store.path("shards")
    (placed.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").select(record, "shard")
     .write.mode("overwrite").partitionBy("shard").text(path))
    return path


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, from_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, ids (bytes) of all records from a slot on; whole shards before it are not opened."""
    step = stride(length)
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # no sequences, no shards
        files = files.withColumn("shard", F.lit(0))
    files = files.filter(F.col("shard") >= from_slot // shard_rows)
    rows = files.select(F.col("shard").cast("long").alias("shard"), "content",
                        F.explode(F.sequence(F.lit(0), (F.length("content") / step).cast("int") - 1)).alias("_k"))
    out = rows.select((F.col("shard") * shard_rows + F.col("_k")).alias("slot"), "shard", (F.col("_k") * step).cast("long").alias("byte_offset"),
                      F.substring(F.col("content"), F.col("_k") * step + 1, F.lit(2 * length)).alias("ids"))
    return out.filter(F.col("slot") >= from_slot)
