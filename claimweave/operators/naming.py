"""Reference checks against a symbol table and near-name suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4


def _substrings(name):
    """All non-empty substrings of a short name (names are identifiers, not texts)."""
    starts = F.sequence(F.lit(1), F.length(name))
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.length(name) - i + 1), lambda n: F.substring(name, i, n)
                ),
            )
        )
    )


def _first(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` smallest candidates per key, by an aggregate that keeps only k rows.

    A bounded rank window: Spark drops rows beyond rank k before the shuffle as well.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy("candidate"))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def near_names(missing: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """Up to ``k`` known names, by name, that resemble each missing name (column ``name``).

    Two names resemble each other, ignoring case, when one contains the other or they
    share a prefix of four characters.  Each of the three cases is an equi join; within a
    shared prefix or substring only the k smallest names can be among the k answers, so
    the rest is dropped before the join.
    """
    wanted = missing.select("name").distinct().withColumn("_low", F.lower("name"))
    have = known.select(F.col("name").alias("candidate")).distinct()
    have = have.withColumn("_low", F.lower("candidate"))

    long_enough = F.length("_low") >= PREFIX
    by_prefix = _first(
        have.filter(long_enough).select(F.substring("_low", 1, PREFIX).alias("_key"), "candidate"),
        "_key",
        k,
    )
    prefix_hits = wanted.filter(long_enough).withColumn(
        "_key", F.substring("_low", 1, PREFIX)
    ).join(by_prefix, "_key")

    # The missing name contains a known one.
    parts = wanted.select("name", F.explode(_substrings(F.col("_low"))).alias("_key"))
    inside = _first(have.select(F.col("_low").alias("_key"), "candidate"), "_key", k)
    contains_hits = parts.join(inside, "_key")

    # A known name contains the missing one: only substrings that are asked for survive.
    asked = wanted.select(F.col("_low").alias("_key")).distinct()
    pieces = have.select("candidate", F.explode(_substrings(F.col("_low"))).alias("_key"))
    around = _first(pieces.join(asked, "_key", "left_semi"), "_key", k)
    contained_hits = wanted.withColumn("_key", F.col("_low")).join(around, "_key")

    hits = (
        prefix_hits.select("name", "candidate")
        .unionByName(contains_hits.select("name", "candidate"))
        .unionByName(contained_hits.select("name", "candidate"))
        .distinct()
    )
    return _first(hits, "name", k)


def common_prefix_length(a, b):
    """Length of the common prefix of two short strings."""
    upto = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    same = F.filter(upto, lambda n: F.substring(a, 1, n) == F.substring(b, 1, n))
    return F.array_max(same)


def check_references(imports: DataFrame, symbols: DataFrame, used: DataFrame) -> DataFrame:
    """Status of every import: ``resolved``, ``module-mismatch`` or ``missing``; plus ``unused``.

    ``imports(path, module, name, alias)``, ``symbols(name, module)`` with one row per
    name, ``used(path, name)``.
    """
    table = symbols.select("name", F.col("module").alias("graph_module"))
    seen = (
        used.select("path", F.col("name").alias("alias"))
        .distinct()
        .withColumn("_used", F.lit(True))
    )
    status = (
        F.when(F.col("graph_module").isNull(), "missing")
        .when(F.col("graph_module") != F.col("module"), "module-mismatch")
        .otherwise("resolved")
    )
    return (
        imports.join(table, "name", "left")
        .join(seen, ["path", "alias"], "left")
        .select(
            "path", "module", "name", "graph_module", status.alias("status"),
            F.col("_used").isNull().alias("unused"),
        )
    )
