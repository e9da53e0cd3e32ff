"""History, as-of comparison and the transaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordered import number_in_group
from claimweave.graph import SUPERSEDES, ClaimGraph


def hidden_since(graph: ClaimGraph) -> DataFrame:
    """``(cid, hidden_seq)``: when each superseded claim was first hidden."""
    return (
        graph.claims_where(p=SUPERSEDES)
        .groupBy(F.col("r").alias("cid"))
        .agg(F.min("tx_seq").alias("hidden_seq"))
    )


def value_history(graph: ClaimGraph, predicate: str | None = None) -> DataFrame:
    """Every value of each ``(l, p)``, oldest first, with the interval it was visible in."""
    claims = graph.claims_where(p=predicate).filter(F.col("p") != SUPERSEDES)
    timed = claims.join(hidden_since(graph), "cid", "left")
    return number_in_group(timed, ["l", "p"], "ord", "version").select(
        "l", "p", "r", "version", F.col("tx_seq").alias("valid_from"),
        F.col("hidden_seq").alias("valid_to"),
    )


def state_diff(graph: ClaimGraph, before: int, after: int) -> DataFrame:
    """Triples that differ between two points in time: ``added`` or ``removed``.

    One pass: each claim carries the interval in which it is visible, so the two states
    need one join and one aggregate rather than two anti joins and a full outer join.
    """
    timed = graph.claims.filter(F.col("tx_seq") <= max(before, after)).join(
        hidden_since(graph), "cid", "left"
    )

    def visible(seq: int):
        gone = F.coalesce(F.col("hidden_seq") <= seq, F.lit(False))
        return F.max((F.col("tx_seq") <= seq) & ~gone)

    return (
        timed.groupBy("l", "p", "r")
        .agg(visible(before).alias("_was"), visible(after).alias("_is"))
        .filter(F.col("_was") != F.col("_is"))
        .select("l", "p", "r", F.when(F.col("_is"), "added").otherwise("removed").alias("change"))
    )


def changed_values(graph: ClaimGraph, before: int, after: int) -> DataFrame:
    """Per ``(l, p)`` with one value removed and another added: old and new value."""
    diff = state_diff(graph, before, after)
    added, removed = F.col("change") == "added", F.col("change") == "removed"
    return (
        diff.groupBy("l", "p")
        .agg(
            F.max(F.when(removed, F.col("r"))).alias("old_r"),
            F.max(F.when(added, F.col("r"))).alias("new_r"),
        )
        .filter(F.col("old_r").isNotNull() & F.col("new_r").isNotNull())
    )


def claims_since(graph: ClaimGraph, seq: int) -> DataFrame:
    return graph.claims.filter(F.col("tx_seq") > seq)


def latest_seq(graph: ClaimGraph) -> DataFrame:
    return graph.txs.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("seq"))


def claim_transactions(graph: ClaimGraph) -> DataFrame:
    """``(cid, tx_id, seq, agent)``.  ``tx_seq`` sits on the claim; only the agent is joined."""
    agents = graph.txs.select("tx_id", "agent")
    return graph.claims.select("cid", "tx_id", F.col("tx_seq").alias("seq")).join(
        agents, "tx_id", "left"
    )


def claims_by_agent(graph: ClaimGraph, agent: str) -> DataFrame:
    mine = graph.txs.filter(F.col("agent") == agent).select("tx_id")
    return graph.claims.join(mine, "tx_id", "left_semi")


def tx_sizes(graph: ClaimGraph) -> DataFrame:
    """Claims per transaction with the agent; transactions without claims count 0."""
    sizes = graph.claims.groupBy("tx_id").agg(F.count(F.lit(1)).alias("claims"))
    return graph.txs.join(sizes, "tx_id", "left").select(
        "tx_id", "seq", "agent", F.coalesce("claims", F.lit(0)).alias("claims")
    )


def tx_log(graph: ClaimGraph, since: int = 0, limit: int = 20) -> DataFrame:
    """The oldest ``limit`` transactions after ``since``, oldest first.

    The transactions are chosen before their claims are counted, so only the claims of
    the chosen ones are aggregated.
    """
    return _sized(graph, graph.txs.filter(F.col("seq") > since).orderBy("seq").limit(limit))


def recent_transactions(graph: ClaimGraph, limit: int = 5) -> DataFrame:
    return _sized(graph, graph.txs.orderBy(F.col("seq").desc()).limit(limit))


def _sized(graph: ClaimGraph, chosen: DataFrame) -> DataFrame:
    sizes = (
        graph.claims.join(chosen.select("tx_id"), "tx_id", "left_semi")
        .groupBy("tx_id")
        .agg(F.count(F.lit(1)).alias("claims"))
    )
    return (
        chosen.join(sizes, "tx_id", "left")
        .select("tx_id", "seq", "agent", F.coalesce("claims", F.lit(0)).alias("claims"))
        .orderBy("seq")
    )
