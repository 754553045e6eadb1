"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """One folder for a process whose session names none; used on a local master only."""
    return tempfile.mkdtemp(prefix="factloom-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or, where that is unset, of its context; a temporary folder on a local master only."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at:
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


class Stage:
    """A folder of intermediate tables of one run of an operator.

    ``cut`` writes a DataFrame and returns a reader of what was written, so later plans start from files: a lost
    executor costs the re-reading of files only.  ``drop`` removes a table that no later step reads; tables that the
    returned, lazy result reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
