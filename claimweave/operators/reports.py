"""Counts, degrees, rankings and adjacency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.skew import attach_sizes
from claimweave.graph import ClaimGraph


def status(graph: ClaimGraph) -> DataFrame:
    """One row: objects, claims, live rules, transactions, latest sequence number.

    Each count is its own one-row aggregate tagged by name; the tags are pivoted by a
    second aggregate over those five rows.
    """
    parts = [
        graph.objects().agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit("objects")),
        graph.claims.agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit("claims")),
        graph.rules.filter("live").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit("rules")),
        graph.txs.agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit("txs")),
        graph.txs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).withColumn(
            "m", F.lit("latest_seq")
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(
        *[
            F.max(F.when(F.col("m") == name, F.col("n"))).cast("bigint").alias(name)
            for name in ("objects", "claims", "rules", "txs", "latest_seq")
        ]
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree per node, 0 where a node appears on one side only.

    Both counts come from one aggregate over the two endpoints of each edge: one shuffle
    with map-side combine instead of two aggregates and a full outer join.
    """
    return (
        edges.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                    F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
                )
            ).alias("e")
        )
        .groupBy("e.node")
        .agg(F.sum("e.o").alias("calls"), F.sum("e.i").alias("called_by"))
    )


def top_targets(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most referenced targets, ties by id."""
    return (
        edges.groupBy(F.col("dst").alias("node"))
        .agg(F.count(F.lit(1)).alias("references"))
        .orderBy(F.col("references").desc(), "node")
        .limit(k)
    )


def uncalled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column ``node``) that no edge points to."""
    return nodes.select("node").join(
        edges.select(F.col("dst").alias("node")), "node", "left_anti"
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference."""
    return left.subtract(right)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` with the number of distinct targets of ``src``.

    Rows rather than one array per source: a hub's targets never gather in one task.
    """
    distinct = edges.select("src", "dst").distinct()
    sizes = distinct.groupBy("src").agg(F.count(F.lit(1)).alias("targets"))
    return attach_sizes(distinct, sizes, "src", "targets")


def group_sizes(members: DataFrame, group: str = "grp", member: str = "member") -> DataFrame:
    """Distinct members per group; the members themselves stay as rows of the input."""
    return (
        members.select(group, member)
        .distinct()
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("members"))
    )


def small_adjacency(edges: DataFrame, separator: str = ",") -> DataFrame:
    """``src`` with its sorted targets as one string; for rule tables and single functions,
    whose targets are few by nature."""
    return (
        edges.select("src", "dst")
        .distinct()
        .groupBy("src")
        .agg(F.array_join(F.array_sort(F.collect_list("dst")), separator).alias("targets"))
    )


def work_summary(
    items: DataFrame, status: str, priority: str, assignee: str, active: list[str]
) -> DataFrame:
    """``(section, item, n)``: per status, active total, active per priority and assignee,
    and active items without an assignee, in one scan.

    Each item yields its report rows, which are combined before the shuffle.
    """
    is_active = F.col(status).isin(*active)

    def row(section: str, item, when):
        return F.when(when, F.struct(F.lit(section).alias("section"), item.alias("item")))

    rows = F.array(
        row("total", F.lit("total"), F.lit(True)),
        row("status", F.col(status).cast("string"), F.col(status).isNotNull()),
        row("active", F.lit("active"), is_active),
        row("priority", F.col(priority).cast("string"), is_active & F.col(priority).isNotNull()),
        row("assignee", F.col(assignee).cast("string"), is_active & F.col(assignee).isNotNull()),
        row("unassigned", F.lit("unassigned"), is_active & F.col(assignee).isNull()),
    )
    return (
        items.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x"))
        .groupBy("x.section", "x.item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
