"""Numbering and neighbours inside a group that may hold a large part of all rows.

A plain window puts a whole group into one task.  Here a group of more than ``span`` rows is
cut by rank, at quantiles of its order column, whatever the distances of its values; each
range is windowed on its own, and a small table with one row per range carries the
offsets.  Order values are unique within a group, so a range holds about ``span`` rows, or a
share of 1 / ``PIECES`` of a group that is larger still.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000
PIECES = 2_000
_RANGE = "_range"


def cut(df: DataFrame, keys: Sequence[str], order: str, span: int = SPAN, pieces: int = PIECES) -> DataFrame:
    """Add ``_range``: 0 in small groups, the number of the quantile range in large ones.

    There are at most rows / span large groups and twice as many cuts in all of them, which
    bounds what is broadcast.  Ranges are ascending in ``order``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > span)
    narrow = df.select(*dict.fromkeys([*keys, order]))
    large = narrow.join(F.broadcast(sizes), list(keys)) if keys else narrow.crossJoin(F.broadcast(sizes))
    # one literal: thousands of them would slow the planner down
    shares = F.split(F.lit(",".join(str(i / pieces) for i in range(1, pieces))), ",").cast("array<double>")
    cuts = large.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(10 * pieces)).alias("_all"), F.first("_n").alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(pieces) * span / (2 * F.col("_n")))).cast("int")
    cuts = cuts.select(*keys, F.filter("_all", lambda x, i: i % step == 0).alias("_cuts"))
    marked = df.join(F.broadcast(cuts), list(keys), "left") if keys else df.join(F.broadcast(cuts), how="left")
    # how many cuts lie below the value, by halving
    powers = F.array(*[F.lit(1 << b) for b in range(pieces.bit_length() - 1, -1, -1)])
    below = F.aggregate(
        powers, F.lit(0), lambda at, b: F.when((at + b <= F.size("_cuts")) & (F.get("_cuts", at + b - 1) < F.col(order)), at + b).otherwise(at)
    )
    return marked.withColumn(_RANGE, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below).cast("bigint")).drop("_cuts")


def number_in_group(
    df: DataFrame, keys: Sequence[str], order: str, out: str, span: int = SPAN
) -> DataFrame:
    """Add ``out`` = 1, 2, ... by ascending ``order`` within ``keys`` (non-null keys)."""
    keyed = cut(df, keys, order, span)
    parts = [*keys, _RANGE]
    local = Window.partitionBy(*parts).orderBy(order)
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = keyed.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, parts)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, out)
    )


def neighbour_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    forward: bool = True,
    span: int = SPAN,
) -> DataFrame:
    """Add each of ``values`` taken from the next (or previous) row of the group."""
    payload = F.struct(*[column.alias(name) for name, column in values.items()])
    keyed = cut(df, keys, order, span).withColumn("_payload", payload)
    parts = [*keys, _RANGE]
    local = Window.partitionBy(*parts).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(_RANGE)
    if forward:
        inside = F.lead("_payload").over(local)
        edge = F.min_by("_payload", order)
        beyond = F.lead("_edge").over(across)
    else:
        inside = F.lag("_payload").over(local)
        edge = F.max_by("_payload", order)
        beyond = F.lag("_edge").over(across)
    edges = (
        keyed.groupBy(*parts).agg(edge.alias("_edge")).withColumn("_beyond", beyond).drop("_edge")
    )
    joined = keyed.withColumn("_inside", inside).join(edges, parts)
    found = F.coalesce("_inside", "_beyond")
    return joined.withColumn("_found", found).select(
        *df.columns, *[F.col(f"_found.{name}").alias(name) for name in values]
    )
