"""Sinks: results, matches, verdicts and predictions. Metadata is a table of its own."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.operators.ordering import stacked



def write_results(results: DataFrame, meta: DataFrame | None, path: str, *, score: str = "imagescore", key: str = "id",
                  by: list[str] = ()) -> None:
    """Results best first within each file set, and run metadata beside them."""
    ordered = results.orderBy(*by, F.col(score).desc(), key)
    ordered.write.mode("overwrite").parquet(f"{path}/results")
    if meta is not None:
        meta.write.mode("overwrite").parquet(f"{path}/run_meta")


def write_cascade(matched: DataFrame, unmatched: DataFrame, bibliographies: dict[str, DataFrame], path: str,
                  *, fmt: str = "parquet") -> None:
    """Matched, unidentified and per-catalog bibliographies below one folder."""
    tables = {"matched": matched, "unidentified": unmatched}
    tables |= {f"bibliography_{name}": df for name, df in bibliographies.items()}
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path}/{name}")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sorted parquet table with `place`, from 0: how many rows its files hold before each one.

    A sorted table is range-partitioned: its files follow each other by name, and the rows of a file
    keep their order. Files are counted, not rows moved.
    """
    rows = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn("place", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def append_log(log: DataFrame, path: str) -> None:
    """Judgments of one or more rounds, added to those there; one folder per run and round."""
    log.write.mode("append").partitionBy("run", "round").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class VersionedTable:
    """A table that is extended or rewritten by readers of itself, as a log of versions.

    A version is a folder with a whole table (`v<n>`) or with rows added to what was there (`d<n>`). Its number is
    claimed by creating a file that must not exist, so two writers never take one number; it counts once it is
    complete, so a job that reads the table while it makes the next version is safe. The table is the last whole
    version and the additions since; an addition writes only its own rows, and `compact` makes a whole version of all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        folder = self._hadoop(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _parts(self) -> list[tuple[int, str]]:
        """(number, folder) of all complete versions, in order."""
        found = [(int(n[1:]), n) for n in self._names() if n[:1] in ("v", "d") and n[1:].isdigit()]
        return sorted(x for x in found if self._fs.exists(self._hadoop(f"{self.path}/{x[1]}/_SUCCESS")))

    def versions(self) -> list[int]:
        return [n for n, _ in self._parts()]

    def _claim(self) -> int:
        """The next number no other writer has, complete or not."""
        taken = [int(d) for d in (re.sub(r"^(_claim-|v|d)", "", n) for n in self._names()) if d.isdigit()]
        number = max(taken, default=0) + 1
        while True:
            try:
                self._fs.create(self._hadoop(f"{self.path}/_claim-{number}"), False).close()
                return number
            except Py4JJavaError:
                if not self._fs.exists(self._hadoop(f"{self.path}/_claim-{number}")):
                    raise
                number += 1

    def read(self, key: str | None = None) -> DataFrame | None:
        """The table; of rows with equal `key` that two writers added at once, the earlier one's."""
        parts = self._parts()
        start = max((k for k, (_, name) in enumerate(parts) if name[0] == "v"), default=0)
        frames = [self.spark.read.parquet(f"{self.path}/{name}") for _, name in parts[start:]]
        if not frames:
            return None
        if key is None or len(frames) < 3:  # one addition meets no other
            return stacked(frames)
        marked = stacked([f.withColumn("_version", F.lit(k)) for k, f in enumerate(frames)])
        first = marked.groupBy(key).agg(F.min("_version").alias("_first")).withColumnRenamed(key, "_key")
        same = marked[key].eqNullSafe(first["_key"]) & (F.col("_version") == F.col("_first"))
        return marked.join(first, same, "left_semi").drop("_version")

    def write(self, df: DataFrame) -> DataFrame:
        """A whole new version."""
        folder = f"{self.path}/v{self._claim()}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def extend(self, rows: DataFrame, key: str) -> DataFrame:
        """Add rows whose key is not there yet; earlier rows stay and are not written again."""
        old = self.read(key)
        if old is None:
            return self.write(rows)
        rows.join(old.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{self.path}/d{self._claim()}")
        return self.read(key)

    def compact(self, key: str | None = None) -> DataFrame | None:
        """One whole version of the table as it is; readers of earlier versions keep theirs."""
        now = self.read(key)
        return None if now is None else self.write(now)
