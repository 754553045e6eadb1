"""Joins whose strategy follows a check of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's estimate of it is at most so many bytes.
BROADCAST_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; for files it starts from their lengths."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", salts: int = 1) -> DataFrame:
    """Joins a large side to a side with unique keys.

    A right side of at most ``BROADCAST_BYTES`` is broadcast.  A larger one is shuffled; with ``salts`` > 1 the rows of
    every key are spread over so many tasks and the right side is repeated for each, so that a key which holds a third
    of all rows does not end in one task.  Rows with a null key stay for left joins, as in a plain join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if estimated_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    if salts <= 1:
        return left.join(right, keys, how)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer tasks than there are cores, as one of a few small files is, over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
