"""Merkle manifest of a table: hash trees stored only at every few levels.

Each row becomes a leaf, the leaves of one tree (one value of a column) stand in order, and
every two consecutive nodes become their parent; a last node without a neighbour is hashed
alone.  What remains of each tree is a leaf of the tree above, whose remaining node is the
root of the table.

Checkpoint and recompute: only levels 0, ``every``, 2 * ``every``, ... are written, cut into
aligned runs of 2^every nodes.  Those runs are whole subtrees, so one row holds all that a
subtree needs, whatever the number of leaves.  Building folds each stored run into one
node of the next stored level.  Taking proofs goes down again: each run makes its missing
interior levels anew, adds the siblings of each of its nodes to those above it, and
drops the levels.  No task holds more than one run and one path.

Defined cases: a null column counts as ``-``; equal order values are ordered by their leaf,
so repeated rows are neighbours, each with its own proof; the null tree comes first; a tree
of one leaf is that leaf, a table of one tree has that tree's node as its root; an empty
table has no root (None) and no proofs.  Columns that are not named do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, globally_numbered, pick
from claimweave.workspace import Stored

EVERY = 10
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<sibling: string, left: boolean>>"


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest (hex) of the values, each with its length in UTF-8 bytes before it."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def interior(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of an aligned subtree above and including ``nodes``, the lowest first."""
    levels = [nodes]
    for _ in range(height):
        low = levels[-1]
        levels.append([parent(low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def _folds(n: int, level: int, every: int) -> int:
    """Levels that a run at a stored level still has above it, within its own subtree."""
    return max(0, min(every, (n - 1).bit_length() - level))


def _hex(column: pa.Array) -> list[str]:
    return [b.hex() for b in column.to_pylist()]


def _next_level(runs: DataFrame, level: int, every: int) -> DataFrame:
    """(tree, n, idx, node) of the next stored level, or of the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            out = []
            for i, n in enumerate(b.column(1).to_pylist()):
                out.append(bytes.fromhex(interior(_hex(lists[i].values), _folds(n, level, every))[-1][0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["tree", "n", "idx", "node"])

    return runs.select("tree", "n", "chunk", "nodes").mapInArrow(run, "tree bigint, n bigint, idx bigint, node binary")


def _runs(nodes: DataFrame, every: int, carry: bool) -> DataFrame:
    """Nodes of one level as aligned runs of at most 2^every, one row each."""
    item = F.struct("idx", "node", "item") if carry else F.struct("idx", "node")
    rows = nodes.groupBy("tree", "n", F.shiftright("idx", every).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("_r"))
    return rows.select("tree", "n", "chunk", F.col("_r.node").alias("nodes"), *[F.col("_r.item").alias("items")] * carry)


class Forest:
    """The trees of numbered leaves, stored at every few levels.

    ``leaves``: tree, n (leaves of the tree), idx (0 to n - 1), node (binary), and item
    (any struct) where something is carried beside the leaves.
    """

    def __init__(self, leaves: DataFrame, work: Workspace, every: int = EVERY):
        self.every = every
        self.carry = "item" in leaves.columns
        self.levels: list[Stored] = []
        self.tops: list[DataFrame] = []
        nodes = leaves
        while True:
            k = len(self.levels)
            stored = work.save(_runs(nodes, every, self.carry and k == 0), f"level{k * every}")
            if stored.rows == 0:
                break
            self.levels.append(stored)
            up = work.save(_next_level(stored.df(), k * every, every), f"nodes{(k + 1) * every}").df()
            last = F.shiftright(F.col("n") - 1, (k + 1) * every) == 0
            self.tops.append(up.filter(last).select("tree", "node"))
            nodes = up.filter(~last)

    def roots(self) -> DataFrame:
        """(tree, node): what remains of each tree."""
        out = self.tops[0]
        for more in self.tops[1:]:
            out = out.unionByName(more)
        return out

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(tree, idx, node, steps[, item]): the siblings of every leaf from its level up.

        ``above`` (tree, steps) are steps from the remaining node of each tree on.
        """
        below_top = None
        for k in range(len(self.levels) - 1, -1, -1):
            runs = self.levels[k].df()
            paths = below_top
            if above is not None:
                ends = above.select(F.col("tree").alias("_tree"), F.lit(0).cast("bigint").alias("_chunk"), F.col("steps").alias("_above"))
                # trees that end at this level take the steps from above, others those of the next stored one
                if k + 1 < len(self.levels):
                    ended = F.shiftright(F.col("n") - 1, (k + 1) * self.every) == 0
                    mine = runs.filter(ended).select(F.col("tree").alias("_t")).distinct()
                    ends = ends.join(mine, F.col("_tree") == F.col("_t"), "left_semi")
                paths = ends if paths is None else paths.unionByName(ends)
            if paths is None:
                runs = runs.withColumn("_above", F.expr(f"cast(array() AS {STEPS})"))
            else:
                runs = runs.join(paths, (F.col("tree") == F.col("_tree")) & (F.col("chunk") == F.col("_chunk")), "left").drop("_tree", "_chunk")
            found = self._paths(runs, k)
            below_top = found.select(F.col("tree").alias("_tree"), F.col("idx").alias("_chunk"), F.col("steps").alias("_above"))
        return found

    def _paths(self, runs: DataFrame, k: int) -> DataFrame:
        every, level = self.every, k * self.every
        carry = self.carry and k == 0

        def one(n: int, chunk: int, nodes: list[str], upper: list[dict]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
            m, height = len(nodes), _folds(n, level, every)
            levels = interior(nodes, height)[:height]
            known = [h for low in levels for h in low] + [s["sibling"] for s in upper]
            side = [s["left"] for s in upper]
            starts = np.cumsum([0, *map(len, levels)])
            at = np.arange(m)
            width = height + len(upper)
            place = np.empty((m, width), dtype=np.int64)
            left = np.empty((m, width), dtype=bool)
            for j, low in enumerate(levels):
                other = (at >> j) ^ 1
                place[:, j] = np.where(other < len(low), starts[j] + other, -1)
                left[:, j] = (at >> j) & 1
            place[:, height:] = starts[-1] + np.arange(len(upper))
            left[:, height:] = side
            flat = place.ravel()
            siblings = pa.array(known, pa.string()).take(pa.array(flat, mask=flat < 0))
            return (chunk << every) + at, np.full(m, width), siblings, pa.array(left.ravel())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    nodes = b.column(3)[i].values
                    upper = b.column(4)[i].as_py() or []
                    idx, width, siblings, left = one(b.column(1)[i].as_py(), b.column(2)[i].as_py(), _hex(nodes), upper)
                    steps = pa.StructArray.from_arrays([siblings, left], names=["sibling", "left"])
                    ends = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                    columns = [pa.array(np.full(len(idx), b.column(0)[i].as_py())), pa.array(idx), nodes, pa.ListArray.from_arrays(ends, steps)]
                    names = ["tree", "idx", "node", "steps"]
                    if carry:
                        columns.append(b.column(5)[i].values)
                        names.append("item")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        given = runs.select("tree", "n", "chunk", "nodes", F.col("_above"), *["items"] * carry)
        schema = f"tree bigint, idx bigint, node binary, steps {STEPS}"
        if carry:
            schema += f", item {runs.schema['items'].dataType.elementType.simpleString()}"
        return given.mapInArrow(run, schema)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    none = F.lit("")

    def up(node: Column, step: Column) -> Column:
        sibling = F.coalesce(step["sibling"], none)
        return F.sha2(F.when(step["left"], F.concat(sibling, node)).otherwise(F.concat(node, sibling)), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's level up."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: s["sibling"])), 256)


class Manifest:
    """``root`` (hex, None for an empty table), the root of each tree, and proofs of all leaves.

    ``rows`` needs ``by`` (the tree), the columns of ``order``, and ``leaf`` (hex); columns of
    ``carry`` come back beside the proofs.
    """

    def __init__(self, rows: DataFrame, by: str, order: Sequence[str], carry: Sequence[str] = (), work: Workspace | None = None, every: int = EVERY):
        work = work or Workspace(rows.sparkSession)
        leaves = rows.select(
            F.col(by).alias("by"),
            F.struct(*order).alias("place"),
            F.unhex("leaf").alias("node"),
            F.struct(F.lit(None).cast("boolean").alias("_"), *carry).alias("item"),
        )
        leaves = work.save(leaves, "leaves").df()
        numbered, n = globally_numbered(leaves, ["by", "place", "node"], work, "sorted")
        self.root: str | None = None
        self.proofs: DataFrame | None = None
        if n == 0:
            return
        trees = work.save(numbered.groupBy("by").agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("n")), "trees").df()
        trees, n_trees = globally_numbered(trees, ["by"], work, "numbered-trees")
        self.trees = work.save(trees.withColumnRenamed("_rank", "tree"), "tree-sizes").df()
        places = self.trees.withColumnRenamed("by", "_by")
        placed = numbered.join(places, F.col("by").eqNullSafe(F.col("_by"))).select(
            "tree", "n", (F.col("_rank") - F.col("first")).alias("idx"), "node", "item"
        )
        self.forest = Forest(placed, work, every)
        roots = self.forest.roots().select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("n"), F.col("tree").alias("idx"), "node")
        self.subroots = work.save(roots, "subroots").df()
        top = Forest(self.subroots, work, every)
        self.root = bytes(top.roots().first()["node"]).hex()  # one row
        above = top.proofs().select(F.col("idx").alias("tree"), "steps")
        above = work.save(above, "above").df()
        found = self.forest.proofs(above)
        subroots = self.subroots.select(F.col("idx").alias("_tree"), F.lower(F.hex("node")).alias("subroot"))
        self.proofs = found.join(subroots, F.col("tree") == F.col("_tree")).select(
            *[F.col(f"item.`{c}`").alias(c) for c in carry], F.lower(F.hex("node")).alias("leaf"), "subroot", F.lit(self.root).alias("root"), "steps"
        )


def verified(manifest: Manifest, leaf: Column) -> DataFrame:
    """The proofs with proof_sha256, and the root that ``leaf`` (hex) leads to by them."""
    return manifest.proofs.withColumn("folded_root", folded(leaf, F.col("steps"))).withColumn("proof_sha256", proof_digest(F.col("steps")))


def tampered_leaf() -> Column:
    """The leaf of a row whose n_chars is one more, where 7 divides the checksum of doc_id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.when(hit, leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]))


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tampering_found(docs: DataFrame, work: Workspace | None = None, every: int = EVERY) -> DataFrame:
    rows = pick(docs, *LEAF_COLUMNS)
    rows = rows.select("doc_id", "lang", leaf_of([F.col(c) for c in LEAF_COLUMNS]).alias("leaf"), F.unhex(tampered_leaf()).alias("changed"))
    made = Manifest(rows, "lang", ["doc_id"], ["doc_id", "changed"], work, every)
    if made.proofs is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    found = verified(made, F.coalesce(F.lower(F.hex("changed")), F.col("leaf")))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampering_found(documents(spark, sf_dir))


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


# The checksum of the decimal digits goes byte by byte over the table of its generator.
SQL = f"""
WITH RECURSIVE gen AS (
    SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM gen WHERE k < 8
),
tab AS (SELECT list(c ORDER BY i) AS tab FROM gen WHERE k = 8),
rows AS (
    SELECT doc_id, coalesce(lang, '') AS t, lang IS NULL AS nolang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('n_chars + 1')} AS changed,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS hit
    FROM documents, tab
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY t, nolang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM rows),
low AS (
    SELECT t, nolang, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY t, nolang) AS size FROM leaves
    UNION ALL
    SELECT t, nolang, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (max(size) + 1) // 2
    FROM low WHERE size > 1 GROUP BY t, nolang, level, idx // 2
),
subroots AS (
    SELECT t, nolang, node AS subroot, level AS height, row_number() OVER (ORDER BY nolang DESC, encode(t)) - 1 AS tree FROM low WHERE size = 1
),
high AS (
    SELECT 0 AS level, tree AS idx, subroot AS node, count(*) OVER () AS size FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (max(size) + 1) // 2
    FROM high WHERE size > 1 GROUP BY level, idx // 2
),
top AS (SELECT node AS root, level AS height FROM high WHERE size = 1),
steps AS (
    SELECT l.t, l.nolang, l.idx, r.level, (l.idx >> r.level) & 1 AS is_right, o.node AS sibling
    FROM leaves l JOIN subroots s USING (t, nolang), range(64) r(level) LEFT JOIN low o
        ON o.t = l.t AND o.nolang = l.nolang AND o.level = r.level AND o.idx = xor(l.idx >> r.level, 1)
    WHERE r.level < s.height
    UNION ALL
    SELECT l.t, l.nolang, l.idx, 100 + r.level, (s.tree >> r.level) & 1, o.node
    FROM leaves l JOIN subroots s USING (t, nolang), top, range(64) r(level) LEFT JOIN high o
        ON o.level = r.level AND o.idx = xor(s.tree >> r.level, 1)
    WHERE r.level < top.height
),
paths AS (
    SELECT t, nolang, idx, list((CASE WHEN is_right = 1 THEN 'R' ELSE 'L' END) || coalesce(sibling, '') ORDER BY level) AS path FROM steps GROUP BY t, nolang, idx
),
folds AS (
    SELECT doc_id, leaf, subroot, root, coalesce(path, []) AS path,
        list_reduce(list_prepend(CASE WHEN hit AND n_changed THEN changed ELSE leaf END, coalesce(path, [])),
            lambda node, step: sha256(CASE WHEN step[1] = 'R' THEN step[2:] || node ELSE node || step[2:] END)) AS folded_root
    FROM (SELECT *, changed <> leaf AS n_changed FROM leaves) JOIN subroots USING (t, nolang) CROSS JOIN top LEFT JOIN paths USING (t, nolang, idx)
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(list_prepend('L', path), lambda step: step[2:]), 'string_agg', '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folds
"""
