"""N-gram Jaccard join by a count-vector R-tree.

A text's set holds the hashes of its distinct word shingles.  Hashing the shingles into 64
groups gives a vector of counts, a point; the coordinate-wise minima of two points sum to at
least the size of the sets' intersection, so a pair whose summed minima stay below the
overlap that the similarity needs cannot link.  The same bound holds for boxes of points.

The tree's top level is an equi join: of a set in a fixed order (common shingles last, then
by hash) two linked sets share one of the first ``n - ceil(t n) + 1``, so each point is
entered under those.  Most of these keys are of one point alone: keys without vectors are
dealt out first, and only those that several points have go on.  Below lie leaves of at most
``LEAF`` points with their boxes.  A
bucket of any size is cut into leaves by a range sort; leaf pairs are bounded by their boxes,
point pairs by their vectors, and what is left is verified on the whole sets.

Links are wanted for their components.  First each leaf gives only a spanning forest of the
pairs that the bounds allow, and those are verified.  Where every pair of a forest links,
its points are one component and nothing is left to do; points of the forests that broke
go through the tree again, in a leaf and across leaves.  In buckets of several leaves the
sets of up to ``WHOLE`` shingles lie in the leaves: their pairs are verified on the spot, and
only links that join two components leave a task, so a large group's near misses are never
listed.  Pairs of one leaf alone, and those with a longer set, leave it when the bounds allow
them and are verified on their whole sets afterwards.  So no link between components is lost.

64 groups bound long sets badly: counts of some dozens are near equal in any two of them.  So
before whole sets move, each pair is bounded once more by summed minima, over as many groups
as leave two to four shingles to each; only sets of pairs that pass are moved.

Equal sets are one point.  Defined cases: a null or wordless text has the empty set, links
to nothing and is its own component (its doc_id, null if that is null); a text with fewer
words than a shingle is one shingle; repeated rows and repeated ids are returned each, with
the component of their text; ties of any kind follow the smaller number.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, in_least, least_type, pick, plain_words, shingle_hashes, split_by_keys, text_batches, whole_rows
from claimweave.workspace import Stored

GROUPS = 64
LEAF = 256
# Sets up to this size (4 kB) are carried in the leaves of large buckets; longer ones, which
# have more keys too, would be written too often.
WHOLE = 512
# A shingle in more than one of this many texts is common; at most words per text times
# this many can be, which bounds what is broadcast.
COMMON_SHARE = 20_000
COMMON_LEAST = 50
# Words of 64 bits, at most, of the bit table that keeps rows back from a join: 4 MB.
MOST_WORDS = 1 << 18
# The shared keys of more points than these are sorted in so many parts, one after the other.
PART_POINTS = 1_000_000
PARTS = 4
# Leaves of up to so many points, and so many of them, are remembered by a task.
SEEN_POINTS = 16
MOST_SEEN = 100_000
# Keys meet in 16 buckets at least, one for the keys of so many points.
BUCKET_POINTS = 20_000


@dataclass(frozen=True)
class Similar:
    """Shingle width and the least similarity as a fraction of whole numbers."""

    width: int = 5
    num: int = 8
    den: int = 10

    def links(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_overlap(self, a, b):
        """Smallest intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n + self.num * -n // self.den + 1 if n else 0


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, ends = plain_words(texts)
    every = shingle_hashes(words, width) if len(words) >= width else words[:0]
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            out.append(np.unique(every[start : end - width + 1]))
        else:
            out.append(shingle_hashes(words[start:end], width))
        start = end
    return out


def common_shingles(docs: DataFrame, width: int, work: Workspace) -> np.ndarray:
    """Shingles of many texts, counted over all texts; the order of shingles is built on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            sets = shingle_sets(texts, width)
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            many = counts > 2  # of one batch: what is common everywhere is common in batches
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["shingle", "n"]
            )

    found = work.save(pick(docs, "text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")), "counts")
    least = max(COMMON_LEAST, docs.count() // COMMON_SHARE)
    rows = found.df().filter(F.col("n") >= least).select("shingle").toPandas()
    work.drop(found)
    return np.sort(rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def _packed(counts: np.ndarray) -> bytes:
    """A count vector in one, two or four bytes a coordinate."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _unpacked(vecs: list[bytes]) -> np.ndarray:
    out = np.empty((len(vecs), GROUPS), dtype=np.int64)
    for i, v in enumerate(vecs):
        out[i] = np.frombuffer(v, dtype=f"<u{len(v) // GROUPS}")
    return out


POINT = "doc_id bigint, h bigint, digest binary, n bigint, vec binary, keys array<bigint>"


def points(docs: DataFrame, like: Similar, common: np.ndarray) -> DataFrame:
    """One row per text: digest and size of its set, its count vector, its bucket keys."""
    given = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = given.value
        for batch, texts in text_batches(batches, "text"):
            sets = shingle_sets(texts, like.width)
            keys, vecs, digests = [], [], []
            for s in sets:
                first = like.prefix(len(s))
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = common[at] == s
                    # s is sorted by hash; common ones come last, by hash too
                    k = s[~often][:first]
                    if len(k) < first:
                        k = np.concatenate([k, s[often][: first - len(k)]])
                else:
                    k = s[:first]
                keys.append(k.view(np.int64))
                vecs.append(_packed(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS)))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array(digests, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(vecs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["doc_id", "h", "digest", "n", "vec", "keys"],
            )

    return pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).mapInArrow(run, POINT)


def shared_keys(reps: DataFrame, n: int) -> DataFrame:
    """(key, node) of the keys that several of the ``n`` points have; ``reps``: node, keys.

    Each task hands on, for each bucket of keys (their first bits), the keys and whose they are.
    """
    bits = max(4, (n // BUCKET_POINTS).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, lists = b.column(0).to_numpy(), b.column(1)
            keys = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
            bucket = least_type(keys >> np.uint64(64 - bits))
            order = np.argsort(bucket, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=1 << bits))).tolist()
            rows = []
            for k, (a, z) in enumerate(zip(ends, ends[1:])):
                if a < z:
                    mine = owner[order[a:z]]
                    there = np.zeros(len(nodes), bool)
                    there[mine] = True
                    rows.append((k, keys[order[a:z]].tobytes(), least_type((np.cumsum(there) - 1)[mine]).tobytes(), nodes[there].tobytes()))
            if rows:
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "keys", "owners", "nodes"])

    def several(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, nodes = (np.concatenate(x) for x in zip(*held))
        every = np.sort(keys)
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if len(twice):
            at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(nodes[at])], names=["key", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                at, keys, owners, nodes = (b.column(c)[k].as_py() for c in range(4))
                if at != bucket and held:
                    yield from several(held)
                    held = []
                bucket = at
                held.append((np.frombuffer(keys, np.uint64), np.frombuffer(nodes, np.int64)[in_least(owners, len(keys) // 8)]))
        if held:
            yield from several(held)

    dealt = reps.mapInArrow(deal, "bucket int, keys binary, owners binary, nodes binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key bigint, node bigint")


def among(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose key is, or seems to be, among the ``n`` of ``wanted``: those a join can need.

    A table with some 16 bits for each wanted key, of at most ``MOST_WORDS`` words, is
    broadcast.  With more keys it is denser and keeps fewer rows back; nothing else changes.
    """
    bits = min(max(6, (16 * n).bit_length()), MOST_WORDS.bit_length() + 5)
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    word, bit = F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.join(F.broadcast(words), word == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(one) != 0).drop("_word", "_bits")


def _fine_groups(n: int) -> int:
    """Groups of the finer vector of a set: a power of two that leaves two to four shingles to each."""
    return max(GROUPS, 1 << max(0, n.bit_length() - 2))


def fine_vector(s: np.ndarray) -> bytes:
    groups = _fine_groups(len(s))
    at = s >> np.uint64(65 - groups.bit_length())
    return _packed(np.bincount(at.astype(np.int64), minlength=groups))


def _least_common(x: bytes, n: int, y: bytes, m: int) -> int:
    """Summed minima of two finer vectors; adjacent groups of the longer one are added up."""
    counts = [np.frombuffer(v, dtype=f"<u{len(v) // _fine_groups(k)}") for v, k in ((x, n), (y, m))]
    least = min(map(len, counts))
    u, v = (c.reshape(least, -1).sum(axis=1, dtype=np.int64) for c in counts)
    return int(np.minimum(u, v).sum())


def _with_both(pairs: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, the columns of a's row and those of b's (with a 2)."""
    left = pairs.select("a", "b").join(sides.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns]), "b")
    both = left.join(sides.select(F.col("node").alias("a"), *columns), "a")
    return both.select("a", "b", *columns, *[f"{c}2" for c in columns])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verified(pairs: DataFrame, sets: DataFrame, like: Similar, work: Workspace) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; ``sets``: node, size, fine, set."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, m, y = (batch.column(k).to_pylist() for k in range(6))
            keep = [
                i
                for i in range(len(a))
                if like.den * min(n[i], m[i]) >= like.num * max(n[i], m[i]) and _least_common(x[i], n[i], y[i], m[i]) >= like.least_overlap(n[i], m[i])
            ]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for i, (s, t) in enumerate(zip(x, y)):
                n, m = len(s) // 8, len(t) // 8
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(t, s), m - 1)
                if like.links(int((t[at] == s).sum()), n, m):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    may = work.save(_with_both(pairs, sets, ["size", "fine"]).mapInArrow(bounded, "a bigint, b bigint"), "bounded")
    needed = among(sets.select("node", "set"), "node", _ends(may.df()), 2 * may.rows)
    return _with_both(may.df(), needed, ["set"]).mapInArrow(run, "a bigint, b bigint")


def connected(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node in a link.

    Alternating rounds link each node's neighbours to its smallest one until only stars are
    left: no node has two centres, and no centre has one.  Each round is written.
    """
    edges = work.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while edges.rows:
        e = edges.df()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        stored = work.save(large, "large")
        large = stored.df()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, work.save(small.distinct(), "small")
        work.drop(before, stored)
        ends = edges.df().select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("x"))
        roles = ends.groupBy("x.node").agg(F.sum("x.leaf").alias("centres"), F.min("x.leaf").alias("leaf"))
        if roles.filter((F.col("centres") > 1) | ((F.col("centres") > 0) & (F.col("leaf") == 0))).isEmpty():
            break
    stars = edges.df()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


LEAVES = (
    "key bigint, leaf bigint, low bigint, high bigint, box array<bigint>, nodes array<bigint>, comps array<bigint>, "
    "sizes array<bigint>, vecs binary, sets array<binary>, a array<bigint>, b array<bigint>, bound array<bigint>"
)


def _allowed(like: Similar, size: int, vec: np.ndarray, sizes: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which points may link to one, by size and by summed minima; the summed minima."""
    may = np.minimum(vec, vecs).sum(axis=1)
    ok = (may >= like.least_overlap(size, sizes)) & (like.den * np.minimum(sizes, size) >= like.num * np.maximum(sizes, size))
    return ok, may


def _linked(like: Similar, one: np.ndarray, sizes: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets link to one; no set is empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum(sizes) - sizes
    both = np.add.reduceat((one[at] == flat).astype(np.int64), starts)
    return like.den * both >= like.num * (len(one) + sizes - both)


def _near(like: Similar, one: tuple, two: tuple | None) -> tuple[list[int], list[int], list[int]]:
    """Inside one leaf or across two: a forest of the links that join components, and pairs
    of different components that the bound allows where a set is not at hand."""
    nodes, comps, sizes, vecs, sets = one
    nodes2, comps2, sizes2, vecs2, sets2 = one if two is None else two
    own = comps.copy()
    own2 = own if two is None else comps2.copy()
    here = np.array([s is not None for s in sets2], dtype=bool)
    a, b, bound = [], [], []
    for i in range(len(nodes)):
        start = i + 1 if two is None else 0
        ok, may = _allowed(like, sizes[i], vecs[i], sizes2[start:], vecs2[start:])
        at = np.flatnonzero(ok & (own2[start:] != own[i])) + start
        if not len(at):
            continue
        known = at[here[at]] if sets[i] is not None else at[:0]
        found = known
        if len(known):
            found = known[_linked(like, sets[i], sizes2[known], [sets2[j] for j in known])]
        for j in found.tolist():
            if own2[j] != own[i]:
                old = own2[j]
                own[own == old] = own[i]
                own2[own2 == old] = own[i]
                a.append(int(nodes[i]))
                b.append(int(nodes2[j]))
                bound.append(int(may[j - start]))
        for j in np.setdiff1d(at, known).tolist():
            a.append(int(nodes[i]))
            b.append(int(nodes2[j]))
            bound.append(int(may[j - start]))
    return a, b, bound


def _hashes(sets: list[bytes | None]) -> list[np.ndarray | None]:
    return [None if s is None else np.frombuffer(s, np.uint64) for s in sets]


def _runs(batches: Iterator[pa.RecordBatch], columns: int, most: int) -> Iterator[tuple[list, bool]]:
    """Rows sorted by key as leaves: rows of one key, at most ``most``; and whether the key
    may have other leaves (it is cut, or it is the first or last of its task)."""
    part: list = []
    first, cut = True, False
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(columns)]):
            if part and row[0] != part[0][0]:
                yield part, first or cut
                part, first, cut = [], False, False
            elif len(part) >= most:
                cut = True
                yield part, True
                part = []
            part.append(row)
    if part:
        yield part, True


def _repeated():
    """Tells whether a leaf of these points was there before in the task: linked texts share many keys."""
    seen: set[tuple] = set()

    def told(part: list) -> bool:
        nodes = tuple([r[1] for r in part])
        if nodes in seen:
            return True
        if len(seen) >= MOST_SEEN:
            seen.clear()
        if len(nodes) <= SEEN_POINTS:
            seen.add(nodes)
        return False

    return told


FOREST = "a bigint, b bigint, key bigint"


def _forest(like: Similar):
    """Per leaf: a spanning forest (a, b) of the pairs that the bounds allow, and for a key
    that may have other leaves each point with its key."""

    most = LEAF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        repeated = _repeated()
        for part, several in _runs(batches, 4, most):
            if not several and repeated(part):
                continue
            if several:
                out += [(r[1], None, r[0]) for r in part]
            if len(part) > 1:
                nodes, sizes = (np.array([r[k] for r in part], dtype=np.int64) for k in (1, 2))
                vecs = _unpacked([r[3] for r in part])
                own = np.arange(len(part))
                for i in range(len(part) - 1):
                    ok = (own[i + 1 :] != own[i]) & _allowed(like, sizes[i], vecs[i], sizes[i + 1 :], vecs[i + 1 :])[0]
                    for j in (np.flatnonzero(ok) + i + 1).tolist():
                        if own[j] != own[i]:
                            out.append((int(nodes[i]), int(nodes[j]), None))
                            own[own == own[j]] = own[i]
            if len(out) > 20_000:
                yield _columns(out, FOREST)
                out = []
        if out:
            yield _columns(out, FOREST)

    return run


def _columns(rows: list[tuple], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[n.split()[0] for n in names.split(", ")])


def _pack(like: Similar):
    """Rows sorted by (key, size) to leaves with their boxes and their own pairs; the points
    stay in leaves whose key may have others."""
    most = LEAF

    def leaf_of(key: int, part: list, number: int, several: bool) -> dict:
        nodes, comps, sizes = (np.array([r[k] for r in part], dtype=np.int64) for k in (1, 2, 3))
        vecs = _unpacked([r[4] for r in part])
        sets = [r[5] for r in part]
        a, b, bound = _near(like, (nodes, comps, sizes, vecs, _hashes(sets)), None)
        if several:
            points = {"nodes": nodes.tolist(), "comps": comps.tolist(), "sizes": sizes.tolist(), "vecs": vecs.astype("<u4").tobytes(), "sets": sets}
        else:
            points = {"nodes": [], "comps": [], "sizes": [], "vecs": b"", "sets": []}
        box = vecs.max(axis=0).tolist() if several else []
        return {"key": key, "leaf": number, "low": int(sizes.min()), "high": int(sizes.max()), "box": box, **points, "a": a, "b": b, "bound": bound}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        out: list = []
        repeated = _repeated()
        for part, several in _runs(batches, 6, most):
            if not several and (len(part) == 1 or repeated(part)):
                continue
            leaf = leaf_of(part[0][0], part, number, several)
            if not several and not leaf["a"]:
                continue
            out.append(leaf)
            number += 1
            if len(out) >= 16:
                yield pa.RecordBatch.from_pylist(out, schema=_leaf_schema())
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_leaf_schema())

    return run


def _leaf_schema() -> pa.Schema:
    many = pa.list_(pa.int64())
    kinds = {"box": many, "nodes": many, "comps": many, "sizes": many, "vecs": pa.binary(), "sets": pa.list_(pa.binary()), "a": many, "b": many, "bound": many}
    return pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in LEAVES.split(", ")])


def _dealt(rows: DataFrame) -> DataFrame:
    """Range-sorted by key and size, so that a key of any size is spread over tasks."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(width, "key", "n", "node").sortWithinPartitions("key", "n", "node")


def tree_pairs(rows: DataFrame, like: Similar, work: Workspace, used: list[Stored]) -> DataFrame:
    """(a, b, bound): of the points of each bucket, links that join components, and pairs
    within the bounds that are still to be verified.

    ``rows``: key, node, comp, n, vec, set (null: not at hand).  ``used`` gets the tables
    that the result reads.
    """
    ordered = _dealt(rows.select("key", "node", "comp", "n", "vec", "set"))
    used.append(work.save(ordered.mapInArrow(_pack(like), LEAVES), "leaves"))
    leaves = used[-1].df()
    inside = leaves.select(F.explode(F.arrays_zip("a", "b", "bound")).alias("x")).select("x.a", "x.b", "x.bound")
    several = leaves.groupBy("key").count().filter("count > 1").select("key")
    boxes = leaves.join(several, "key", "left_semi").select("key", "leaf", "low", "high", "box")
    used.append(work.save(boxes, "boxes"))
    boxes = used[-1].df()
    other = boxes.select("key", *[F.col(c).alias(f"{c}2") for c in ("leaf", "low", "high", "box")])
    may = F.aggregate(F.zip_with("box", "box2", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda x, y: x + y)
    total = F.col("low") + F.col("low2")
    met = boxes.join(other, "key").filter(
        (F.col("leaf") < F.col("leaf2"))
        & (like.den * F.col("high") >= like.num * F.col("low2"))
        & (like.den * F.col("high2") >= like.num * F.col("low"))
        & (may * (like.num + like.den) >= total * like.num)
    )
    side = ["nodes", "comps", "sizes", "vecs", "sets"]
    full = (
        met.select("leaf", "leaf2")
        .join(leaves.select("leaf", *side), "leaf")
        .join(leaves.select(F.col("leaf").alias("leaf2"), *[F.col(c).alias(f"{c}2") for c in side]), "leaf2")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                one, two = (
                    (
                        *(np.array(r[c + s], dtype=np.int64) for c in side[:3]),
                        np.frombuffer(r["vecs" + s], "<u4").reshape(-1, GROUPS).astype(np.int64),
                        _hashes(r["sets" + s]),
                    )
                    for s in ("", "2")
                )
                found = _near(like, one, two)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "bound"])

    across = full.select(*side, *[f"{c}2" for c in side]).mapInArrow(run, "a bigint, b bigint, bound bigint")
    every = inside.unionByName(across)
    return every.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("bound").alias("bound"))


def components(docs: DataFrame, like: Similar = Similar()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    work = Workspace(spark, tidy=True)
    common = common_shingles(docs, like.width, work)
    whole = work.save(points(docs, like, common), "points")
    every = whole.df()
    reps = (
        every.filter("n > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = work.save(reps, "keyed")
    parts = PARTS if keyed.rows > PART_POINTS else 1
    every = work.save(every.select("doc_id", "n", "digest"), "rows").df()
    work.drop(whole)  # keys and vectors are those of the representatives
    shared = work.save(shared_keys(keyed.df().select("node", "keys"), keyed.rows), "shared").df()
    reps = work.save(keyed.df().drop("keys"), "reps").df()
    work.drop(keyed)
    entered = shared.join(reps.select("node", "n", "vec"), "node").select("key", "node", "n", "vec")
    trees = []
    for k in range(parts):  # a part of the keys is sorted at a time
        mine = entered.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
        trees.append(work.save(_dealt(mine).mapInArrow(_forest(like), FOREST), "forest"))
    forest = functools.reduce(Stored.plus, trees).df()
    pairs = work.save(forest.filter("b IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    cut = forest.filter("key IS NOT NULL").select("key", F.col("a").alias("node"))
    several = cut.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_hi")).filter("b <> _hi").drop("_hi")
    together = cut.join(several, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    together = work.save(together, "together")
    work.drop(*trees)
    comp = spark.createDataFrame([], "node bigint, comp bigint")
    if pairs.rows or together.rows:
        # every later pair is of these points, so texts move once
        ends = pairs.df().select("a", "b").unionByName(together.df())
        nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
        nodes = work.save(nodes, "nodes")
        wanted = reps.join(nodes.df(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
        sets = _sets(docs, wanted, nodes.rows, like.width, work)
        links = work.save(verified(pairs.df(), sets, like, work), "links")
        comp = work.save(connected(links.df(), work), "comp").df() if links.rows else comp
        kin = work.save(connected(pairs.df().select("a", "b").unionByName(together.df()), work), "kin").df()
        kin = kin.select("node", F.col("comp").alias("kin")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        broken = kin.groupBy("kin").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("kin")
        still = kin.join(broken, "kin").select("node", "comp")
        apart = work.save(still, "apart")
        if apart.rows:
            rows = shared.join(reps.select("node", "n", "vec").join(apart.df(), "node"), "node").select("key", "node", "comp", "n", "vec")
            large = work.save(rows.groupBy("key").count().filter(F.col("count") > LEAF).select("key", F.lit(True).alias("_large")), "large")
            rows = rows.join(large.df(), "key", "left")
            short = sets.filter(F.col("size") <= WHOLE).select("node", "set")
            with_sets = rows.filter("_large").join(short, "node", "left").select("key", "node", "comp", "n", "vec", "set")
            rows = with_sets.unionByName(rows.filter("_large IS NULL").select("key", "node", "comp", "n", "vec", F.lit(None).cast("binary").alias("set")))
            used: list[Stored] = []
            left = work.save(tree_pairs(rows, like, work, used).join(pairs.df().select("a", "b"), ["a", "b"], "left_anti"), "left")
            work.drop(*used)
            for last in (False, True):
                if left.rows == 0:
                    break
                open_ = left.df().join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
                open_ = open_.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
                open_ = open_.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
                # first the likeliest pair of each two components, then all that are still apart
                wanted = work.save(open_.select("a", "b") if last else _one_per_components(open_, -F.col("bound")), "wanted")
                if wanted.rows == 0:
                    break
                found = work.save(verified(wanted.df(), sets, like, work), "more")
                if found.rows:
                    links = links.plus(found)
                    comp = work.save(connected(links.df(), work), "comp").df()
    member = reps.select("node", "digest", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = member.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_digest = member.join(named, "comp").select("digest", "component_id")
    by_digest = work.save(by_digest, "named").df()
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return every.select("doc_id", "n", "digest").join(by_digest, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def _one_per_components(pairs: DataFrame, order) -> DataFrame:
    low, high = F.least("ca", "cb").alias("_low"), F.greatest("ca", "cb").alias("_high")
    best = pairs.groupBy(low, high).agg(F.min_by(F.struct("a", "b"), F.struct(order, "a", "b")).alias("x"))
    return best.select("x.a", "x.b")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int, work: Workspace) -> DataFrame:
    """(node, size, fine, set) of the wanted points, read again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(fine_vector, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "size", "fine", "set"],
            )

    wanted = work.save(wanted, "sought").df()
    texts = among(pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")), "h", wanted.select(F.col("_h").alias("h")), n_wanted)
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    found = met.select("node", "text").mapInArrow(run, "node bigint, size bigint, fine binary, set binary")
    stored = work.save(found, "sets")
    # more rows than points only where rows of the table repeat
    return stored.df() if stored.rows <= n_wanted else work.save(stored.df().dropDuplicates(["node"]), "sets-once").df()


def near_duplicates_removed(docs: DataFrame, like: Similar = Similar()) -> DataFrame:
    """Of each component the rows of its smallest doc_id (one of them, if repeated)."""
    work = Workspace(docs.sparkSession, tidy=True)
    found = components(docs, like).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    # a document that stays and is there once need not move
    asked = work.save(found.filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), "stays"), "asked")
    rows = whole_rows(docs, _doc=F.col("doc_id").cast("bigint"), _text=F.col("text"))
    may, single = split_by_keys(rows, "_doc", asked.df().select(F.col("_id").alias("_doc")), asked.rows)
    kept = may.join(asked.df().filter("NOT stays").select("_id"), F.col("_doc").eqNullSafe(F.col("_id")), "left_anti")
    return single.select("_all.*").unionByName(kept.dropDuplicates(["_doc", "_text"]).select("_all.*"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir), Similar(width=3, num=9, den=10))
