"""Document fingerprints by locally consistent parsing.

The code points of a text are cut into short phrases by deterministic coin tossing: runs of
one symbol become one symbol; each symbol is labelled by the lowest bit in which it differs
from its left neighbour, three times over, which leaves labels below 8 that never repeat
side by side; a phrase starts at each local maximum of the labels.  A phrase is named by a
hash of its symbols and the names are parsed again, level by level, until one name is left.
Every cut depends on a few symbols around it only, so equal passages get equal names inside,
wherever they stand.

The fingerprint is the sketch (smallest hashes) of all names from ``FIRST_LEVEL`` on and of
the top name; likeness is the Jaccard similarity estimated from two sketches.

Defined cases: a null text is an empty one; the empty text has an empty fingerprint, alike
(1) to itself and unlike (0) to all others; a text too short for phrases of that level is
known by its top name alone; equal texts have equal fingerprints.  The next document is by
ascending doc_id (nulls first), repeated ids by a hash of the text; a lone document is next
to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, mix, pick

FIRST_LEVEL = 3
SKETCH = 64
ROUNDS = 3
CHUNK = 1_000_000
U = np.uint64


# Odd multipliers by place in a phrase (three labels below 8 bound a phrase by 16 symbols).
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def _label(here: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit differing from the left neighbour, plus that bit's value."""
    one = here.dtype.type(1)
    differ = np.empty_like(here)
    np.bitwise_xor(here[1:], here[:-1], out=differ[1:])
    differ[first] = one
    lowest = differ & (~differ + one)
    label = np.bitwise_count(lowest - one)
    label += label
    label += (here & lowest) != 0
    return label


def parse_level(names: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each text and the text each belongs to."""
    new_doc = np.empty(len(doc), dtype=bool)
    new_doc[0] = True
    np.not_equal(doc[1:], doc[:-1], out=new_doc[1:])
    head = new_doc.copy()
    head[1:] |= names[1:] != names[:-1]
    if not head.all():
        at = np.flatnonzero(head)
        runs = np.diff(at, append=len(names))
        names, doc, new_doc = names[at], doc[at], new_doc[at]
        long = runs > 1
        names[long] = mix(names[long] + runs[long].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    first = np.flatnonzero(new_doc)
    labels = names.astype(np.uint32)
    for _ in range(ROUNDS):
        labels = _label(labels, first)
    cut = np.zeros(len(labels), dtype=bool)
    np.greater(labels[1:], labels[:-1], out=cut[1:])
    cut[:-1] &= ~cut[1:]
    cut[first] = True
    start = np.flatnonzero(cut).astype(np.int32)
    place = np.arange(len(labels), dtype=np.int32)
    place -= np.repeat(start, np.diff(start, append=np.int32(len(labels))))
    place &= 63
    terms = _PLACE.take(place)
    terms *= names
    return mix(np.add.reduceat(terms, start) + U(level)), doc[start]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Sorted sketch of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    empty = np.zeros(0, dtype=np.uint32)
    if not lengths.sum():
        return [empty] * len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    names = (codes + np.uint32(1)) * U(0x9E3779B97F4A7C15)
    names ^= names >> U(29)
    kept = []
    level = 0
    while len(names):
        level += 1
        names, doc = parse_level(names, doc, level)
        single = np.ones(len(doc), dtype=bool)
        same = doc[1:] == doc[:-1]
        single[1:] &= ~same
        single[:-1] &= ~same
        take = slice(None) if level >= FIRST_LEVEL else single
        kept.append((doc[take].astype(np.uint64) << U(32)) | (names[take] >> U(32)))
        names, doc = names[~single], doc[~single]
    keys = np.unique(np.concatenate(kept))
    owner = (keys >> U(32)).astype(np.int64)
    hashes = keys.astype(np.uint32)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [hashes[a : min(b, a + SKETCH)] for a, b in zip(starts[:-1], starts[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two sketches: of the smallest hashes of both, the shared part."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    mine, yours = set(a.tolist()), set(b.tolist())
    both = sorted(mine | yours)[:SKETCH]
    return sum(h <= both[-1] for h in mine & yours) / len(both)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited(text: str, follower: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each next to the one after it."""
    own = sketches(texts)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = sketches(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([as_text(s) for s in own[:-1]], pa.string()),
            pa.array([as_text(s) for s in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        names=[c.split()[0] for c in OUT.split(", ")],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by piece and order; the last row of a piece is the first of the next."""
    ids: list = []
    texts: list[str] = []
    piece, size = None, 0
    for batch in batches:
        for p, last, i, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            text = text or ""
            if p != piece:
                ids, texts, piece, size = [], [], p, 0
            texts.append(text)
            size += len(text)
            if not last:
                ids.append(i)
            # every text but the newest has its follower
            if len(texts) > 1 and (last or size > CHUNK):
                keep = len(texts) - 1
                yield _rows(ids[:keep], texts)
                ids, texts, size = ids[keep:], texts[-1:], len(text)


def fingerprints(docs: DataFrame, piece_bytes: int = 24_000_000) -> DataFrame:
    """Fingerprint of each text and of its edit, and the likeness of neighbours.

    The texts move once: rows are dealt into pieces of neighbouring doc_ids (cut at
    quantiles), and each piece also gets the first row of the next piece, found by id.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    rows = pick(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-size // piece_bytes), spark.sparkContext.defaultParallelism)
    points = [k / pieces for k in range(1, pieces)]
    cuts = docs.agg(F.percentile_approx("doc_id", points, 10 * pieces)).first()[0] if points else None
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts or []))]).cast("array<bigint>")
    piece = F.when(F.col("doc_id").isNull(), 0).otherwise(
        F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    )
    rows = rows.withColumn("_piece", piece)
    first = rows.groupBy("_piece").agg(F.min(F.struct("doc_id", "_h")).alias("_first"))
    first = work.save(first, "first").df()  # one row per piece
    from pyspark.sql import Window

    ring = first.select(
        F.col("_piece").alias("_to"),
        F.coalesce(F.lead("_first").over(Window.orderBy("_piece")), F.first("_first").over(Window.orderBy("_piece"))).alias("_f"),
    )
    follower = (
        rows.drop("_piece")
        .join(
            F.broadcast(ring),
            F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("_h") == F.col("_f._h")),
        )
        .dropDuplicates(["_to"])
        .select(F.col("_to").alias("_piece"), F.lit(True).alias("_last"), "doc_id", "text", "_h")
    )
    dealt = rows.select("_piece", F.lit(False).alias("_last"), "doc_id", "text", "_h").unionByName(follower)
    if hasattr(dealt, "repartitionById"):
        dealt = dealt.repartitionById(pieces, F.col("_piece").cast("int"))
    else:
        dealt = dealt.repartitionByRange(pieces, "_piece")
    ordered = dealt.sortWithinPartitions("_piece", "_last", "doc_id", "_h")
    return ordered.select("_piece", "_last", "doc_id", "text").mapInArrow(_scan, OUT)


def op3_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
