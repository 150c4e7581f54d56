"""Running totals from a judgment log while a run is still writing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = (
    "id bigint, grp bigint, slot int, kept int, input_tokens bigint, output_tokens bigint, run int, round int"
)


def log_stream(spark: SparkSession, path: str, schema: str = LOG, max_files: int | None = None) -> DataFrame:
    """Stream of a log folder partitioned by run and round."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def running_scores(log: DataFrame) -> DataFrame:
    """Rounds survived so far per image. Of a round written twice the first row counts here;
    the batch reading of the finished log, where the last one counts, is the result."""
    return log.dropDuplicates(["run", "round", "id"]).groupBy("run", "id").agg(
        F.sum("kept").alias("imagescore"), F.count("*").alias("rounds_seen")
    )


def running_tokens(log: DataFrame) -> DataFrame:
    """Calls and tokens so far per run; a group's tokens stand on each of its rows and count once."""
    calls = log.dropDuplicates(["run", "round", "grp"])
    return calls.groupBy("run").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def catch_up(totals: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Bring a totals table up to what the log holds now, then stop.

    Each batch writes the changed keys only, to a folder of its own number, so that a repeated batch is harmless.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )


def _complete(spark: SparkSession, sink: str) -> dict[str, list[int]]:
    """Numbers of the complete folders of each kind: batches, and totals that stand for all batches up to theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(sink).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "upto": []}
    for status in files.listStatus(path(sink)):
        name = status.getPath().getName()
        kind, _, number = name.partition("=")
        if kind in found and number.isdigit() and files.exists(path(f"{sink}/{name}/_SUCCESS")):
            found[kind].append(int(number))
    return found


def latest(spark: SparkSession, sink: str, key: list[str]) -> DataFrame:
    """The totals now: the newest row of each key, from the last compacted totals and the batches since."""
    done = _complete(spark, sink)
    base = max(done["upto"], default=-1)
    folders = [f"{sink}/upto={base}"] * (base >= 0) + [f"{sink}/batch={n}" for n in sorted(done["batch"]) if n > base]
    rows = spark.read.parquet(*folders).withColumn("_folder", F.col("_metadata.file_path"))
    rest = [c for c in rows.columns if c not in (*key, "_folder")]
    number = F.regexp_extract("_folder", r"(?:batch|upto)=(\d+)/[^/]*$", 1).cast("long")
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), number).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, sink: str, key: list[str]) -> None:
    """Write the totals as one folder and delete what it stands for; to be called while no batch runs.

    The folder counts once it is complete; what is deleted before a failure, it already stands for.
    """
    done = _complete(spark, sink)
    if not done["batch"]:
        return
    last = max(done["batch"])
    if last > max(done["upto"], default=-1):
        latest(spark, sink, key).write.mode("overwrite").parquet(f"{sink}/upto={last}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(sink).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, numbers in done.items():
        for n in numbers:
            if kind == "batch" or n < last:
                files.delete(path(f"{sink}/{kind}={n}"), True)
