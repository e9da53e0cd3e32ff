"""Set-at-a-time changes.  Each returns the claims to append; nothing is rewritten.

A request whose ``r`` is the id of a long literal may carry the text as ``lit``; it travels
with the new claim.  Requests carry an integer ``ord`` that is unique in the batch and larger than every
``ord`` already in the graph.  New claims are named ``c:<tx_seq>/<ord>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ids import entity_id, long_text, value_id
from claimweave.functions.ordered import neighbour_in_group
from claimweave.graph import SUPERSEDES, ClaimGraph
from claimweave.operators.closure import reach


def _claim(
    tx_seq: int, cid: Column, l: Column, p: Column, r: Column, order: Column, *more: Column
) -> list[Column]:
    return [
        cid.alias("cid"), l.alias("l"), p.alias("p"), r.alias("r"),
        F.lit(f"t:{tx_seq}").alias("tx_id"), F.lit(tx_seq).cast("bigint").alias("tx_seq"),
        order.cast("bigint").alias("ord"), *more,
    ]


def _text(requests: DataFrame) -> list[Column]:
    return [F.col("lit")] if "lit" in requests.columns else []


def _new_cid(tx_seq: int) -> Column:
    return F.concat(F.lit(f"c:{tx_seq}/"), F.col("ord").cast("string"))


def _hide(tx_seq: int, by: Column, target: Column, order: Column, text: Sequence[Column] = ()) -> list[Column]:
    """A claim that ``by`` supersedes ``target``; its id follows from the target."""
    cid = F.concat(F.lit(f"c:{tx_seq}/hide/"), target)
    none = F.lit(None).cast("string").alias("lit")
    return _claim(tx_seq, cid, by, F.lit(SUPERSEDES), target, order, *[none for _ in text])


def supersede(requests: DataFrame, tx_seq: int) -> DataFrame:
    """Replace claim ``old_cid`` by ``(l, p, r)``; requests have ``old_cid, l, p, r, ord``."""
    text = _text(requests)
    new = requests.select(*_claim(tx_seq, _new_cid(tx_seq), *map(F.col, ("l", "p", "r", "ord")), *text))
    marks = requests.select(*_hide(tx_seq, _new_cid(tx_seq), F.col("old_cid"), F.col("ord"), text))
    return new.unionByName(marks)


def invalidate(cids: DataFrame, tx_seq: int) -> DataFrame:
    """Hide the claims named in column ``cid``, each by its own marker entity."""
    marker = entity_id("marker", F.col("cid"))
    return cids.select("cid").distinct().select(
        *_hide(tx_seq, marker, F.col("cid"), F.lit(0))
    )


def update(graph: ClaimGraph, requests: DataFrame, tx_seq: int) -> DataFrame:
    """Set properties; requests have ``l, p, r, ord`` with ``r`` an object id.

    The first request for an ``(l, p)`` supersedes every live claim of it, and each later
    request in the batch supersedes the one before it.
    """
    text = _text(requests)
    chained = neighbour_in_group(
        requests.select("l", "p", "ord"),
        ["l", "p"],
        "ord",
        {"previous": F.col("ord")},
        forward=False,
    )
    new = requests.select(*_claim(tx_seq, _new_cid(tx_seq), *map(F.col, ("l", "p", "r", "ord")), *text))
    first = requests.groupBy("l", "p").agg(F.min("ord").alias("ord"))
    live = graph.current().select("l", "p", F.col("cid").alias("old"))
    on_live = live.join(first, ["l", "p"]).select(
        *_hide(tx_seq, _new_cid(tx_seq), F.col("old"), F.col("ord"), text)
    )
    earlier = F.concat(F.lit(f"c:{tx_seq}/"), F.col("previous").cast("string"))
    in_batch = chained.filter(F.col("previous").isNotNull()).select(
        *_hide(tx_seq, _new_cid(tx_seq), earlier, F.col("ord"), text)
    )
    return new.unionByName(on_live).unionByName(in_batch)


def assert_claims(requests: DataFrame, tx_seq: int) -> DataFrame:
    """Add ``(l, p, r, ord)`` without hiding anything: a property may have many values."""
    return requests.select(*_claim(tx_seq, _new_cid(tx_seq), *map(F.col, ("l", "p", "r", "ord")), *_text(requests)))


def rename(
    graph: ClaimGraph, requests: DataFrame, tx_seq: int, predicate: str = "name"
) -> DataFrame:
    """Give new names to ``(l, name, ord)``; every reference keeps its id."""
    wanted = requests.select("l", F.lit(predicate).alias("p"), value_id("s", F.col("name")).alias("r"), "ord", "name")
    wanted = wanted.withColumn("lit", long_text(F.col("r"), F.col("name"))).drop("name")
    return update(graph, wanted, tx_seq)


def retract(graph: ClaimGraph, requests: DataFrame, tx_seq: int) -> DataFrame:
    """Hide every live claim of the requested ``(l, p)``."""
    hit = graph.current().join(requests.select("l", "p").distinct(), ["l", "p"], "left_semi")
    return invalidate(hit.select("cid"), tx_seq)


def unlink(graph: ClaimGraph, requests: DataFrame, tx_seq: int) -> DataFrame:
    """Hide the live claims of the requested ``(l, p, r)``."""
    keys = ["l", "p", "r"]
    hit = graph.current().join(requests.select(*keys).distinct(), keys, "left_semi")
    return invalidate(hit.select("cid"), tx_seq)


def change_operand(
    graph: ClaimGraph, requests: DataFrame, tx_seq: int
) -> tuple[DataFrame, DataFrame]:
    """Replace ``old_r`` by ``new_r`` on ``(l, p)`` where it is live.

    Returns the new claims and the requests without a matching live claim.  Of several
    matching claims the newest is replaced.
    """
    live = (
        graph.current()
        .groupBy("l", "p", F.col("r").alias("old_r"))
        .agg(F.max_by("cid", "ord").alias("old_cid"))
    )
    matched = requests.join(live, ["l", "p", "old_r"])
    claims = supersede(
        matched.select("old_cid", "l", "p", F.col("new_r").alias("r"), "ord"), tx_seq
    )
    return claims, requests.join(live, ["l", "p", "old_r"], "left_anti")


def tree_edges(graph: ClaimGraph, predicates: list[str]) -> DataFrame:
    return (
        graph.current()
        .filter(F.col("p").isin(*predicates))
        .select(F.col("l").alias("src"), F.col("r").alias("dst"))
    )


def remove_subtrees(
    graph: ClaimGraph,
    roots: DataFrame,
    child_predicates: list[str],
    tx_seq: int,
    keep_root: bool = False,
    workspace=None,
) -> DataFrame:
    """Hide every live claim made about the roots (column ``node``) and their descendants.

    ``keep_root`` leaves the roots' own claims alone except the links to their children,
    which is the first half of replacing a subtree under an unchanged id.
    """
    found = reach(tree_edges(graph, child_predicates), roots, workspace=workspace)
    live = graph.current()
    if not keep_root:
        hit = live.join(found.select(F.col("node").alias("l")), "l", "left_semi")
        return invalidate(hit.select("cid"), tx_seq)
    below = found.filter(F.col("depth") > 0).select(F.col("node").alias("l"))
    inner = live.join(below, "l", "left_semi").select("cid")
    tops = roots.select(F.col("node").alias("l")).distinct()
    links = (
        live.filter(F.col("p").isin(*child_predicates)).join(tops, "l", "left_semi").select("cid")
    )
    return invalidate(inner.unionByName(links), tx_seq)


def replace_subtrees(
    graph: ClaimGraph,
    roots: DataFrame,
    replacement: DataFrame,
    child_predicates: list[str],
    tx_seq: int,
    new_names: DataFrame | None = None,
    workspace=None,
) -> DataFrame:
    """Swap what hangs below each root for ``replacement`` claims; root ids stay valid."""
    removed = remove_subtrees(
        graph, roots, child_predicates, tx_seq, keep_root=True, workspace=workspace
    )
    claims = removed.unionByName(replacement, allowMissingColumns=True)
    if new_names is not None:
        claims = claims.unionByName(rename(graph, new_names, tx_seq), allowMissingColumns=True)
    return claims
