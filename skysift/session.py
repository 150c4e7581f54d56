"""Session settings and tables that cut lineage between eager steps."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# What a cluster job should start from; everything else is left to the caller.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "skysift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with CLUSTER_CONF, overridden by `conf` (dots written as given)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster.

    A temporary folder is used only where none is named and the one process of a
    local master is all there is, which is the case in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


class TableStore:
    """Writes intermediate results as parquet below the shared folder.

    A written table cuts lineage, survives the loss of executors, and makes a
    result that must not be computed twice (a judge's decisions) fixed. A store
    given a name can be opened again to go on with an interrupted run.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.named = name is not None
        self.root = f"{shared_dir(spark)}/{name or 'tables-' + uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame | None:
        """The table of this name, or None if it was never finished."""
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return None

    def write_once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, made and written only if it is not there yet."""
        found = self.read(name) if self.named else None
        return self.write(make(), name) if found is None else found

    def drop(self) -> None:
        """Delete all tables of this store; results that read them must be saved first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
