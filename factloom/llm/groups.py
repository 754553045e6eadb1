"""Groups of records from pairwise matches, by Borůvka hooking.

Every component selects its smallest outgoing edge, the trees of selected edges collapse by pointer doubling, edges are
relabelled and deduplicated, until none remain.  The smallest record of a component hooks onto its smallest neighbour
and that neighbour hooks back, so it is the root of its tree in every round and the final label is the smallest record.

Pairs with a null or equal sides and repeated pairs add nothing; with no pairs left the result is empty.  All state
between rounds lies in written tables; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage

#: Tasks over which the rows of one hub, parent or root are spread where its side is too large to broadcast.
SALTS = 16


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (group_id, member) for each record that occurs in a pair of two different records."""
    stage = Stage(pairs.sparkSession, "groups")
    edges = stage.cut(
        pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(a) != F.col(b)).alias("_pair")).where("_pair").select("u", "v").distinct(),
        "edges0",
    )
    labels, k = None, 0
    while not edges.isEmpty():
        # the smallest outgoing edge of a component is that to its smallest neighbour; partial minima precede the shuffle
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("n")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("n")))
        hooks = stage.cut(both.groupBy("c").agg(F.min("n").alias("n")), f"hooks{k}")
        back = hooks.select(F.col("c").alias("n"), F.col("n").alias("nn"))
        parent = F.when((F.col("nn") == F.col("c")) & (F.col("c") < F.col("n")), F.col("c")).otherwise(F.col("n"))
        trees, depth = stage.cut(lookup_join(hooks, back, "n", "inner", salts=SALTS).select("c", parent.alias("p")), f"trees{k}_0"), 0
        while True:
            over = trees.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            doubled = stage.cut(lookup_join(trees, over, "p", "inner", salts=SALTS).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), f"trees{k}_{depth + 1}")
            stage.drop(f"trees{k}_{depth}")
            trees, depth = doubled.select("c", "p"), depth + 1
            if doubled.where("moved").isEmpty():
                break
        roots = trees.select(F.col("c").alias("root"), F.col("p").alias("next"))
        old = labels
        if labels is None:
            moved = trees.select(F.col("c").alias("member"), F.col("p").alias("root"))
        else:
            moved = lookup_join(labels, roots, "root", "left", salts=SALTS).select("member", F.coalesce("next", "root").alias("root"))
        labels = stage.cut(moved, f"labels{k}")
        if old is not None:
            stage.drop(f"labels{k - 1}")
        u = lookup_join(edges, trees.select(F.col("c").alias("u"), F.col("p").alias("ru")), "u", "inner", salts=SALTS)
        uv = lookup_join(u, trees.select(F.col("c").alias("v"), F.col("p").alias("rv")), "v", "inner", salts=SALTS).where("ru <> rv")
        edges = stage.cut(uv.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"edges{k + 1}")
        stage.drop(f"edges{k}", f"hooks{k}", f"trees{k}_{depth}")
        k += 1
    if labels is None:
        return edges.select(F.col("u").alias("group_id"), F.col("v").alias("member"))
    return labels.select(F.col("root").alias("group_id"), "member")


def known_pairs(pairs: DataFrame, a: str, b: str, records: DataFrame, key: str) -> DataFrame:
    """The pairs of which both sides are records; a side that is none links nothing."""
    ids = records.where(F.col(key).isNotNull()).select(key).distinct()
    first = pairs.join(ids.withColumnRenamed(key, "_a"), F.col(a) == F.col("_a"), "left_semi")
    return first.join(ids.withColumnRenamed(key, "_b"), F.col(b) == F.col("_b"), "left_semi")


def assign_groups(records: DataFrame, key: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A group for every distinct record: that of its pairs with other records, or itself alone."""
    found = connected_groups(known_pairs(pairs, a, b, records, key), a, b).withColumnRenamed("member", key)
    return records.where(F.col(key).isNotNull()).select(key).distinct().join(found, key, "left").select(F.coalesce("group_id", key).alias("group_id"), key)
