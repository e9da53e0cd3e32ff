"""Reachability over edge tables by delta rounds.

Each round joins only the pairs found in the round before, drops what is known and
writes the rest.  Known pairs are a growing list of written rounds, so nothing is
rewritten.  Cyclic graphs end because a round with no new pair stops the loop.

Looking for the known pairs moves all of them, every round.  A closure therefore goes on by
``STRIDE`` steps a round once the paths of up to so many steps are there: a shortest path
of ``d`` to ``d + STRIDE`` steps passes a node that is exactly ``d`` steps away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.workspace import DENSE, FEW_ROWS, Stored, Workspace, unseen, rounds

# Steps of a round of a closure: more means fewer rounds, and more ways to find one pair.
STRIDE = 4


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def transitive_closure(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    workspace: Workspace | None = None,
    max_rounds: int | None = None,
    squaring: bool = False,
) -> DataFrame:
    """Pairs ``(src, dst)`` joined by a path, with ``depth`` = length of the shortest one.

    ``squaring`` joins paths with paths and needs a logarithmic number of rounds on deep
    graphs; it does not know the depth and returns only the pairs.
    """
    space = workspace or Workspace(edges.sparkSession)
    base = space.save(_edges(edges, src, dst), "edges")
    if squaring:
        return _closure_by_squaring(space, base, max_rounds)
    return closure_of(space, base, max_rounds).df()


def closure_of(space: Workspace, base: Stored, max_rounds: int | None = None) -> Stored:
    """Pairs of the two columns of ``base`` (distinct edges) with ``depth``, in strides unless rounds are limited."""
    src, dst = base.schema.names
    stride = STRIDE if max_rounds is None else 1
    steps = delta = known = space.save(base.df().withColumn("depth", F.lit(1)), "paths")
    depth, most = 1, 1
    for _ in rounds(1, max_rounds):
        if delta.rows == 0:
            return known
        ahead = steps.df().select(F.col(src).alias("mid"), F.col(dst).alias("next"), F.col("depth").alias("more"))
        ends = delta.df().filter(F.col("depth") == depth).select(src, F.col(dst).alias("mid"))
        reached = ends.join(ahead, "mid").select(src, F.col("next").alias(dst), (F.col("more") + depth).alias("depth"))
        delta = space.save(_unseen_shortest(reached, known), "paths")
        known = known.plus(delta)
        depth += most
        if depth == stride:
            steps, most = known, stride
    raise RuntimeError(f"closure not finished after {max_rounds} rounds")


def _unseen_shortest(candidates: DataFrame, known: Stored, few: int = FEW_ROWS) -> DataFrame:
    """The candidates' pairs that ``known`` does not hold yet, each with its smallest depth."""
    key = candidates.columns[:2]
    if known.rows <= few:
        seen = known.df().select(*[F.col(c).alias(f"_{c}") for c in key])
        same = F.col(key[0]).eqNullSafe(F.col(f"_{key[0]}")) & F.col(key[1]).eqNullSafe(F.col(f"_{key[1]}"))
        return candidates.groupBy(*key).agg(F.min("depth").alias("depth")).join(seen, same, "left_anti")
    both = candidates.unionByName(known.df().select(*key, F.lit(0).alias("depth")))
    return both.groupBy(*key).agg(F.min("depth").alias("depth")).filter("depth > 0")


def _closure_by_squaring(space: Workspace, base: Stored, max_rounds: int | None) -> DataFrame:
    known, delta = base, base
    for _ in rounds(1, max_rounds):
        if delta.rows == 0:
            return known.df()
        new, full = delta.df(), known.df()
        ahead = new.select("src", F.col("dst").alias("mid")).join(
            full.select(F.col("src").alias("mid"), "dst"), "mid"
        )
        behind = full.select("src", F.col("dst").alias("mid")).join(
            new.select(F.col("src").alias("mid"), "dst"), "mid"
        )
        reached = ahead.select("src", "dst").unionByName(behind.select("src", "dst"))
        delta = space.save(unseen(reached, known), "paths")
        known = known.plus(delta)
    raise RuntimeError(f"closure not finished after {max_rounds} rounds")


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    src: str = "src",
    dst: str = "dst",
    keep_root: bool = False,
    include_seeds: bool = True,
    workspace: Workspace | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """Nodes reachable from ``seeds`` (column ``node``), with their smallest depth.

    Without ``keep_root`` the whole seed set is one frontier: each node is visited once,
    however many seeds reach it.  With ``keep_root`` rows are ``(root, node, depth)``.
    ``include_seeds`` keeps the seeds at depth 0.
    """
    space = workspace or Workspace(edges.sparkSession)
    stored = space.save(_edges(edges, src, dst), "edges", **DENSE)
    steps = stored.df().select(F.col("src").alias("mid"), F.col("dst").alias("node"))
    key = ["root", "node"] if keep_root else ["node"]
    first = seeds.select("node").distinct()
    if keep_root:
        first = first.withColumn("root", F.col("node")).select("root", "node")
    delta = space.save(first.withColumn("depth", F.lit(0)), "frontier")
    known = delta
    for depth in rounds(1, max_rounds):
        if delta.rows == 0:
            space.drop(stored)
            found = known.df()
            return found if include_seeds else found.filter(F.col("depth") > 0)
        reached = (
            delta.df()
            .withColumnRenamed("node", "mid")
            .drop("depth")
            .join(steps, "mid")
            .select(*key)
        )
        fresh = unseen(reached, known).withColumn("depth", F.lit(depth))
        delta = space.save(fresh, "frontier")
        known = known.plus(delta)
    raise RuntimeError(f"frontier not empty after {max_rounds} rounds")


def affected_by(
    depends_on: DataFrame, changed: DataFrame, workspace: Workspace | None = None
) -> DataFrame:
    """Everything that depends, directly or not, on a changed node, and the node itself.

    ``depends_on`` has columns ``(src, dst)`` meaning *src depends on dst*.
    """
    backwards = depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(backwards, changed, workspace=workspace)


def subtree(
    children: DataFrame, roots: DataFrame, workspace: Workspace | None = None
) -> DataFrame:
    """All descendants of each root, the root included: ``(root, node, depth)``."""
    return reach(children, roots, keep_root=True, workspace=workspace)


def impact(depends_on: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """Per target: how many nodes depend on it directly, in all, and only indirectly."""
    backwards = depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    paths = transitive_closure(backwards, workspace=workspace)
    return paths.groupBy(F.col("src").alias("target")).agg(
        F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("direct"),
        F.count(F.lit(1)).alias("transitive"),
        F.sum(F.when(F.col("depth") > 1, 1).otherwise(0)).alias("indirect_only"),
    )
