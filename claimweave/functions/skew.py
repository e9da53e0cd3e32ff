"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is joined by broadcast.  At most rows / HEAVY keys can
# be that heavy, so their table is small whatever the data looks like.
HEAVY = 1_000_000


def attach_sizes(df: DataFrame, sizes: DataFrame, key: str, size: str, heavy: int = HEAVY) -> DataFrame:
    """Add ``size`` from ``sizes`` (one row per key of ``df``, counting its rows in ``df``).

    Grouping and joining on one key share a shuffle, which the adaptive skew handling
    cannot split.  Heavy keys therefore meet a broadcast table and leave the shuffle.
    """
    top = sizes.filter(F.col(size) > heavy).select(
        F.col(key).alias("_heavy"), F.col(size).alias("_heavy_size")
    )
    rest = sizes.filter(F.col(size) <= heavy).select(
        F.col(key).alias("_light"), F.col(size).alias("_light_size")
    )
    marked = df.join(F.broadcast(top), F.col(key) == F.col("_heavy"), "left")
    light = F.when(F.col("_heavy").isNull(), F.col(key).cast("string")).otherwise(
        spread(df.columns)
    )
    return (
        marked.withColumn("_key", light)
        .join(rest.withColumn("_light", F.col("_light").cast("string")), F.col("_key") == F.col("_light"), "left")
        .withColumn(size, F.coalesce("_heavy_size", "_light_size"))
        .select(*df.columns, size)
    )


def attach(df: DataFrame, facts: DataFrame, key: str, counted: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``df`` left joined with ``facts`` on ``key``, whatever share of the rows one key holds.

    ``counted`` has the keys of ``df``, once per row.  The facts of heavy keys, few by that
    count, are broadcast; rows with such a key or none stay spread in the join with the rest.
    """
    names = [c for c in facts.columns if c != key]
    top = counted.groupBy(F.col(key).alias("_heavy")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).select("_heavy")
    there = F.broadcast(top).join(facts, F.col("_heavy") == F.col(key), "left").select("_heavy", *[F.col(n).alias(f"_heavy_{n}") for n in names])
    rest = facts.join(F.broadcast(top), F.col(key) == F.col("_heavy"), "left_anti").select(
        F.col(key).alias("_light"), *[F.col(n).alias(f"_light_{n}") for n in names]
    )
    marked = df.join(F.broadcast(there), F.col(key) == F.col("_heavy"), "left")
    marked = marked.withColumn("_own", F.col("_heavy").isNull() & F.col(key).isNotNull())
    marked = marked.withColumn("_key", F.when(F.col("_own"), F.col(key)).otherwise(spread(df.columns)))
    joined = marked.join(rest, (F.col("_key") == F.col("_light")) & F.col("_own"), "left")
    return joined.select(*df.columns, *[F.coalesce(f"_heavy_{n}", f"_light_{n}").alias(n) for n in names])


def spread(columns: Sequence[str]) -> Column:
    """A key that matches nothing and is spread over all partitions.

    Rows that need no partner would otherwise share one NULL key, hence one task.
    """
    return F.concat(F.lit("~"), F.xxhash64(*columns).cast("string"))
