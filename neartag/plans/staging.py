"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="neartag-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Python gets wide rows in batches of some megabytes; the number of rows alone does not bound them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


class Staging:
    """Writes tables under one fresh folder and reads them back.

    A staged table cuts the lineage, survives lost executors, and is read by column.
    ``close`` (or the end of a ``with`` block) deletes the folder; results that still read
    from it must be written first.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/neartag-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def child(self, name: str) -> Staging:
        """A fresh folder inside this one, for another run of the same job."""
        return Staging(self.spark, f"{self.path}/{name}-{uuid.uuid4().hex[:8]}")

    def write(self, df: DataFrame, name: str, partition_by: str | None = None,
              compression: str = "snappy") -> DataFrame:
        """``partition_by`` names a column of few values whose filters should skip files."""
        target = f"{self.path}/{name}"
        writer = df.write.option("compression", compression)
        (writer if partition_by is None else writer.partitionBy(partition_by)).parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target).select(df.columns)

    def close(self) -> None:
        """Delete the folder through the file system that holds it."""
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
