"""Readers of the table files of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory; a file or a directory of part files alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
