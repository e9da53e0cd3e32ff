"""Property reads: newest and all values, names, symbols, object reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.graph import ClaimGraph
from claimweave.rules import constant_id


def newest(live: DataFrame) -> DataFrame:
    """The newest of the given claims per ``(l, p)``.

    An aggregate, not a window: partial results are combined before the shuffle, so a
    property with very many claims does not pile up in one task.
    """
    return live.groupBy("l", "p").agg(
        F.max_by("r", "ord").alias("r"),
        F.max_by("cid", "ord").alias("cid"),
        F.max("ord").alias("ord"),
    )


def lookup(graph: ClaimGraph, predicate: str | None = None, entity: str | None = None) -> DataFrame:
    """Newest live property per (entity, predicate); ``value`` is the literal or the link."""
    found = newest(graph.current(l=entity, p=predicate))
    return _with_value(graph, found).select("l", "p", "r", "value", "cid")


def lookup_all(
    graph: ClaimGraph, predicate: str | None = None, entity: str | None = None
) -> DataFrame:
    """All live property values."""
    found = graph.current(l=entity, p=predicate)
    return _with_value(graph, found).select("l", "p", "r", "value", "cid")


def _with_value(graph: ClaimGraph, df: DataFrame) -> DataFrame:
    return graph.ground(df, "r", "_literal").withColumn("value", F.coalesce("_literal", "r"))


def find_by(graph: ClaimGraph, predicate: str, value: object) -> DataFrame:
    """Entities having a literal, or a link given as ``ref(id)``."""
    return graph.current(p=predicate, r=constant_id(value)).select("l")


def names(graph: ClaimGraph, predicate: str = "name") -> DataFrame:
    """``(id, name)`` from the newest live name claim."""
    found = newest(graph.current(p=predicate))
    return graph.ground(found, "r", "name").select(F.col("l").alias("id"), "name")


def with_names(graph: ClaimGraph, df: DataFrame, *columns: str) -> DataFrame:
    """Replace each id column by the display name, or keep the id when it has none."""
    known = names(graph)
    for column in columns:
        named = known.select(F.col("id").alias(column), F.col("name").alias("_name"))
        df = (
            df.join(named, column, "left")
            .withColumn(column, F.coalesce("_name", column))
            .drop("_name")
        )
    return df


def resolve_symbols(
    graph: ClaimGraph,
    wanted: DataFrame,
    symbol: str = "symbol",
    name: str = "name",
    position: str = "position",
) -> DataFrame:
    """Entity of each name in column ``name``.

    Live symbol claims win over live name claims; then entities that are not parameters
    (no position claim, hidden or not); then the newest claim.
    """
    keys = wanted.select("name").distinct().withColumn("r", ids.value_id("s", F.col("name")))
    named = graph.current().filter(F.col("p").isin(symbol, name)).select("l", "p", "r", "ord")
    placed = (
        graph.claims_where(p=position)
        .select("l")
        .distinct()
        .withColumn("placed", F.lit(True))
    )
    rank = F.struct(
        F.when(F.col("p") == symbol, 1).otherwise(0),
        F.when(F.col("placed"), 0).otherwise(1),
        F.col("ord"),
        F.col("l"),
    )
    best = (
        keys.join(named, "r")
        .join(placed, "l", "left")
        .groupBy("name")
        .agg(F.max_by("l", rank).alias("entity"))
    )
    return keys.select("name").join(best, "name", "left")


def classify_objects(graph: ClaimGraph, wanted: DataFrame) -> DataFrame:
    """Kind and display text of each id in column ``id``: value, named, claim, entity, unknown."""
    known = graph.objects()
    found = wanted.select("id").distinct().join(known, "id", "left").join(names(graph), "id", "left")
    found = graph.ground(found, "id", "literal")
    kind = (
        F.when(F.col("kind").isNull(), "unknown")
        .when(F.col("kind") == "value", "value")
        .when(F.col("name").isNotNull(), "named")
        .otherwise(F.col("kind"))
    )
    return found.select("id", kind.alias("kind"), F.coalesce("literal", "name").alias("display"))


def inspect(graph: ClaimGraph, wanted: DataFrame) -> DataFrame:
    """Claims about and targeting each id, with the superseded flag, plus one row on itself."""
    keys = wanted.select("id").distinct()
    flagged = graph.flagged()
    about = keys.join(flagged.withColumn("id", F.col("l")), "id").select(
        "id", F.lit("about").alias("direction"), "cid", "p", F.col("r").alias("other"), "superseded"
    )
    targeting = keys.join(flagged.withColumn("id", F.col("r")), "id").select(
        "id", F.lit("targeting").alias("direction"), "cid", "p", F.col("l").alias("other"),
        "superseded",
    )
    itself = keys.join(flagged.withColumn("id", F.col("cid")), "id").select(
        "id", F.lit("claim").alias("direction"), "cid", "p",
        F.concat_ws(" ", "l", "p", "r").alias("other"), "superseded",
    )
    kinds = classify_objects(graph, keys).select(
        "id", F.lit("self").alias("direction"), F.lit(None).cast("string").alias("cid"),
        F.col("kind").alias("p"), F.col("display").alias("other"), F.lit(False).alias("superseded"),
    )
    return kinds.unionByName(about).unionByName(targeting).unionByName(itself)


def wide(graph: ClaimGraph, predicates: Sequence[str]) -> DataFrame:
    """One row per entity with the newest value of each predicate (short literals and links)."""
    live = graph.current().filter(F.col("p").isin(*predicates))

    def pick(predicate: str) -> Column:
        mine = F.col("p") == predicate
        newest_r = F.max_by(F.when(mine, F.col("r")), F.when(mine, F.col("ord")))
        return newest_r.alias(predicate)

    rows = live.groupBy("l").agg(*[pick(p) for p in predicates])
    for predicate in predicates:
        rows = graph.ground(rows, predicate, "_lit").withColumn(
            predicate, F.coalesce("_lit", predicate)
        ).drop("_lit")
    return rows


def ordered_children(
    graph: ClaimGraph, child: str, position: str = "position", missing: int = 999
) -> DataFrame:
    """Children of each parent with their position; a child without one counts as ``missing``.

    Rows ``(parent, position, child)``: order by position when writing or showing them.
    """
    links = graph.current(p=child).select(F.col("l").alias("parent"), F.col("r").alias("child"))
    placed = newest(graph.current(p=position)).select(
        F.col("l").alias("child"), ids.short_literal(F.col("r")).cast("bigint").alias("position")
    )
    return links.join(placed, "child", "left").select(
        "parent", F.coalesce("position", F.lit(missing)).alias("position"), "child"
    )
