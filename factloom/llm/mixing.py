"""Mixing sources to target shares of all tokens.

Tokens are summed by source, a source's repetition rate is what its share of the whole needs over what it has, at most
its cap, and each document is emitted floor(rate) times plus once more with the rate's fraction as probability, drawn
from a hash of its key and a seed.

Null texts count no tokens; sources without a target are left out of the mixture but count in the whole; a target
without documents can't be reached unless its share is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.joins import lookup_join

_BUCKETS = 1 << 40


def source_rates(sized: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """For each target: tokens it has and needs, its rate, and whether it can reach the share."""
    sums = sized.groupBy(source).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0)).cast("long")).alias("has_tokens"))
    whole = sums.agg(F.sum("has_tokens").alias("all_tokens"))
    has = targets.select(source, "target_share", "max_repeats").join(sums, source, "left").crossJoin(F.broadcast(whole))  # one row
    need = F.col("target_share") * F.col("all_tokens")
    has = has.withColumn("has_tokens", F.coalesce("has_tokens", F.lit(0).cast("long"))).withColumn("need_tokens", need)
    most = F.col("has_tokens") * F.col("max_repeats")
    rate = F.when(F.col("has_tokens") > 0, F.least(F.col("need_tokens") / F.col("has_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return has.withColumn("rate", rate).withColumn("reachable", F.coalesce(most >= F.col("need_tokens"), F.lit(False)))


def mixture(sized: DataFrame, rates: DataFrame, key: str, source: str = "source", seed: int = 7) -> DataFrame:
    """The mixture: each copy of each document as a row, with its number from 0."""
    drawn = lookup_join(sized, rates.select(source, "rate"), source, "inner")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(_BUCKETS)) / F.lit(_BUCKETS)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return drawn.withColumn("_copies", copies).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "rate")


def reached_shares(mixed: DataFrame, rates: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """Target and reached share of each source, documents and tokens it contributes."""
    sums = mixed.groupBy(source).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0)).cast("long")).alias("tokens"), F.count("*").alias("documents"))
    whole = sums.agg(F.sum("tokens").alias("_all"))
    out = rates.select(source, "target_share", "max_repeats", "rate", "reachable").join(sums, source, "left").crossJoin(F.broadcast(whole))  # one row
    out = out.withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long"))).withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))
    return out.withColumn("share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")
