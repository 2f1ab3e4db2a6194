"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark 4.1's setting by which the shuffle files of a finished query go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir.

    Where it is unset, a local session, which is one process, gets a temporary folder; a cluster gets an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Intermediate tables of one run of an operator, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written as a table and read again; the shuffle files behind it are not needed any more and go."""
        conf, path = self.spark.conf, f"{self.at}/{name}"
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = hadoop(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str | Column = "doc_id", n: int = 5) -> Column:
    """crc32 of the key as text, modulo n: the deterministic split into folds."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n
