"""Tables in the shared folder that cut lineage between the steps of an operator.

A step that is read several times, or that ends an iteration, is written as Parquet under the
folder in ``spark.checkpoint.dir``, which driver and executors share.  A lost executor then
costs the tasks that ran on it, never an earlier step.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one is made where none is set and all tasks run in this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-fernlake-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Scratch tables of one operator call.

    ``keep`` writes a DataFrame and returns the table read back; ``close`` deletes all tables
    but those the result still reads (``keep(..., last=True)``), which the caller of the operator
    may delete by their folder when the result is no longer wanted.  With ``sweep`` the shuffle files of a
    table go as soon as it is written, instead of when the driver collects garbage, and tables are packed tighter.
    """

    def __init__(self, spark: SparkSession, sweep: bool = False):
        self.spark, self.sweep = spark, sweep
        self.root = f"{shared_dir(spark)}/fernlake-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(SWEEP, None)
        if self.sweep:
            self.spark.conf.set(SWEEP, "true")
        try:
            df.write.parquet(path, compression="zstd" if self.sweep else None)
        finally:
            if self.sweep:
                self.spark.conf.set(SWEEP, before) if before is not None else self.spark.conf.unset(SWEEP)
        table = self.spark.read.schema(df.schema).parquet(path)
        if not last:
            self.tables.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table that `keep` returned; any other DataFrame is left alone."""
        for one, path in self.tables:
            if one is table:
                remove(self.spark, path)
        self.tables = [x for x in self.tables if x[0] is not table]

    def close(self) -> None:
        for _, path in self.tables:
            remove(self.spark, path)
        self.tables = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
