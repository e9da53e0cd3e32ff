"""Nodes that share a target, and hops along edges, without enumerating pairs of a group.

The pairs ``(a, b, c)`` with edges a->c and b->c are quadratic in the size of the group
around ``c``.  They are kept factorised: the edges themselves, how many partners each
edge has, and exact answers for given pairs or given nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.skew import attach_sizes


def k_hop(edges: DataFrame, k: int) -> DataFrame:
    """Distinct ``(src, dst)`` joined by exactly ``k`` edges.

    Duplicates are dropped after every hop, so a hub on the way does not multiply rows.
    """
    base = edges.select("src", "dst").distinct()
    step = base.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    found = base
    for _ in range(k - 1):
        found = (
            found.select("src", F.col("dst").alias("mid"))
            .join(step, "mid")
            .select("src", F.col("next").alias("dst"))
            .distinct()
        )
    return found


def shared_targets(edges: DataFrame) -> DataFrame:
    """``(a, c, partners)``: per distinct edge, how many nodes b (a included) also reach c.

    The number of pairs around c is the sum of ``partners`` over its edges.
    """
    base = edges.select(F.col("src").alias("a"), F.col("dst").alias("c")).distinct()
    sizes = base.groupBy("c").agg(F.count(F.lit(1)).alias("partners"))
    return attach_sizes(base, sizes, "c", "partners")


def pair_counts(edges: DataFrame) -> DataFrame:
    """``(c, members, pairs)`` with ``pairs`` = members squared, as the pair relation counts."""
    return (
        edges.select("src", "dst")
        .distinct()
        .groupBy(F.col("dst").alias("c"))
        .agg(F.count(F.lit(1)).alias("members"))
        .withColumn("pairs", F.col("members") * F.col("members"))
    )


def shared_by_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For given pairs ``(a, b)``: every target they share.  Two equi joins."""
    base = edges.select("src", "dst").distinct()
    left = base.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    right = base.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "c"])


def partners_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(a, b, c)`` for the nodes ``a`` in column ``node`` of ``seeds``."""
    base = edges.select("src", "dst").distinct()
    mine = base.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return mine.select(F.col("src").alias("a"), F.col("dst").alias("c")).join(
        base.select(F.col("src").alias("b"), F.col("dst").alias("c")), "c"
    ).select("a", "b", "c")


def coupled_through(edges: DataFrame, hub: str) -> DataFrame:
    """Members of the group coupled through one hub: any two of them form a pair."""
    return edges.filter(F.col("dst") == hub).select(F.col("src").alias("member")).distinct()


def hub_groups(closure: DataFrame, hubs: DataFrame) -> DataFrame:
    """For each hub: how many nodes reach it and how many ordered pairs they form."""
    reaching = closure.join(
        hubs.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi"
    )
    return pair_counts(reaching).withColumnRenamed("c", "hub")
