"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing it as Parquet below ``spark.checkpoint.dir`` and reading it back: the
written table survives the loss of any executor, and later jobs do not recompute what stands above it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for the steps that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables of one run, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def path(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "cut", partition_by: list[str] | None = None, compression: str = "snappy", row_group_bytes: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back; small row groups bound what a reader of long rows holds."""
        path = self.path(name)
        writer = df.write.option("compression", compression)
        if row_group_bytes:
            writer = writer.option("parquet.block.size", max(row_group_bytes, 1 << 20))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        # the table is read back, so the step's shuffle files are of no more use
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001  remembered for drop()
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by cut() that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
