"""Ranked lexical search by an Aho-Corasick scan of the documents.

All terms of all items, each between two guards, make one automaton, which is broadcast.  In
a text every character that belongs to no term becomes a guard, so one run of the automaton
over a text yields how often it holds each term, and nothing else: no word list, no
index of the documents.  A term's postings, the items that ask for it and how often, turn the
outputs into scores.

The documents are scanned twice.  The first scan counts texts with a term (N), terms (L) and
texts by term (df); the second one scores.  A task keeps the best ``k`` rows of each item, so at
most ``k`` rows a task and item are sent on; they are ranked by salted groups first and then
by item.

The items are the queries.  They are taken in blocks of at most ``BLOCK_BYTES`` bytes of
text (one longer item alone) and ``BLOCK_ITEMS`` items, two scans each; that bounds the
automaton, the postings, the counts that come to the driver, and the rows a task keeps.

Defined cases: a null, empty or termless text matches nothing and does not count in N; an
item without terms has no rows; every row of the items is ranked by itself, also where an
item_id repeats; repeated documents each take their rank; among equal scores a null doc_id
comes first; without any term in the documents there are no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import Workspace, documents, globally_numbered, pick, table, text_batches

BEST = 20
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 50_000
SALTS = 64
# Cells (text x item) and postings handled at once in a task.
CELLS = 1 << 21
_GUARD = 32
# Bytes of terms are 0-9, A-Z, a-z and all from 128 on, so parts of a character never part.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _GUARD for b in range(256))


def guarded(text: str) -> bytes:
    """The text in bytes, A-Z lower-cased, with a guard before, after and for what is in no term."""
    return f" {text} ".encode("utf-8", "surrogatepass").translate(_PLAIN)


def terms(text: str | None) -> list[bytes]:
    return guarded(text or "").split()


class Queries:
    """A block of items: the automaton of their terms and each term's postings."""

    def __init__(self, texts: list[str | None]):
        self.n_items = len(texts)
        numbers: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for item, text in enumerate(texts):
            for term, times in Counter(terms(text)).items():
                at = numbers.setdefault(term, len(numbers))
                if at == len(postings):
                    postings.append([])
                postings[at].append((item, times))
        self.n_terms = len(numbers)
        self.ends = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
        self.items = np.array([i for p in postings for i, _ in p], dtype=np.int64)
        self.times = np.array([n for p in postings for _, n in p], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for term, at in numbers.items():
            self.automaton.add_word(f" {term.decode('latin-1')} ", at)
        if numbers:
            self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[int, Counter]:
        """Terms of the text, with repeats, and how often it holds each term of the items."""
        if not text:
            return 0, Counter()
        plain = guarded(text)
        gap = np.frombuffer(plain, dtype=np.uint8) == _GUARD
        return int(np.count_nonzero(gap[:-1] & ~gap[1:])), Counter(map(itemgetter(1), self.automaton.iter(plain.decode("latin-1"))))


def _counted(queries: Broadcast):
    """(term, n): texts by term; term -1: texts with a term (N), -2: terms (L)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        held = np.zeros(q.n_terms, dtype=np.int64)
        n_texts = n_terms = 0
        for _, texts in (pair for b in batches for pair in text_batches(iter([b]), "text")):
            for text in texts:
                n, found = q.count(text)
                n_texts += n > 0
                n_terms += n
                if found:
                    held[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(held)
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([n_texts, n_terms])], names=["term", "n"])

    return run


def length_part(n: np.ndarray, n_texts: int, n_terms: int) -> np.ndarray:
    """m of texts with ``n`` terms, in whole numbers of any size."""
    return np.array([75 + 25 * int(x) * n_texts // n_terms for x in n], dtype=np.int64)


class Best:
    """The ``k`` best rows of each item so far: higher scores first, then smaller doc_ids, null before all."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, dtype=np.int64)
        self.rows = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, known doc_id, doc_id

    def add(self, scores: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        """``scores``: one line per text, one column per item."""
        if len(scores) > 4 * self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            np.maximum(self.least, kth, out=self.least)
        text, item = np.nonzero(scores >= self.least)
        more = [item, scores[text, item], known[text], doc[text]]
        rows = [np.concatenate(pair) for pair in zip(self.rows, more)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        last = place == self.k - 1
        self.least[rows[0][last]] = rows[1][last]
        self.rows = [c[place < self.k] for c in rows]


def _scored(queries: Broadcast, weights: Broadcast, n_texts: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        w: np.ndarray = weights.value
        best = Best(q.n_items, k)
        most = max(1, CELLS // max(1, q.n_items))
        ids: list[int | None] = []
        sizes: list[int] = []
        found: list[Counter] = []
        postings = 0

        def flush() -> None:
            each = np.array([len(f) for f in found])
            text = np.repeat(np.arange(len(found)), each)
            term = np.fromiter((t for f in found for t in f), np.int64, len(text))
            tf = np.fromiter((n for f in found for n in f.values()), np.int64, len(text))
            m = length_part(np.array(sizes), n_texts, n_terms)
            part = w[term] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * m[text]))
            wide = q.ends[term + 1] - q.ends[term]
            at = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(q.ends[term], wide)
            scores = np.zeros(len(found) * q.n_items, dtype=np.int64)
            np.add.at(scores, np.repeat(text, wide) * q.n_items + q.items[at], np.repeat(part, wide) * q.times[at])
            known = np.array([d is not None for d in ids], dtype=np.int64)
            best.add(scores.reshape(len(found), q.n_items), known, np.array([d or 0 for d in ids], dtype=np.int64))
            ids.clear(), sizes.clear(), found.clear()

        for batch, texts in (pair for b in batches for pair in text_batches(iter([b]), "text")):
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                n, hits = q.count(text)
                if not hits:
                    continue
                ids.append(doc)
                sizes.append(n)
                found.append(hits)
                here = np.fromiter(hits, np.int64, len(hits))
                postings += int((q.ends[here + 1] - q.ends[here]).sum())
                if len(found) >= most or postings >= CELLS:
                    flush()
                    postings = 0
        if found:
            flush()
        item, score, known, doc = best.rows
        for start in range(0, len(item), 1 << 16):
            cut = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[cut]), pa.array(doc[cut], mask=known[cut] == 0), pa.array(score[cut])], names=["item", "doc_id", "score"]
            )

    return run


def item_blocks(items: DataFrame, n_items: int, block_bytes: int, block_items: int) -> Iterator[tuple[int, int]]:
    """Ranges of numbers of the items (numbered by length) that stay within both bounds.

    Only the numbers of items by doubling of their length come to the driver; an item counts
    as long as the longest of its doubling.
    """
    doubling = F.length(F.bin(F.octet_length(F.coalesce("text", F.lit("")))))
    sizes = sorted((r[0], r[1]) for r in items.groupBy(doubling.alias("d")).count().collect())  # 64 rows at most
    start = at = used = 0
    for d, count in sizes:
        while count:
            room = min(count, (block_bytes - used) >> d, block_items - (at - start))
            if room <= 0 and at > start:
                yield start, at
                start, used = at, 0
                continue
            room = max(1, room)
            at, used, count = at + room, used + (room << d), count - room
    if at > start:
        yield start, at


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    numbered, n_items = globally_numbered(pick(items, "item_id", "text"), [F.octet_length(F.coalesce("text", F.lit(""))), "item_id"], work, "items")
    numbered = work.save(numbered, "numbered-items").df()
    out = None
    for first, end in item_blocks(numbered, n_items, block_bytes, block_items):
        block = numbered.filter(F.col("_rank").between(first, end - 1)).orderBy("_rank").select("text").collect()
        made = Queries([r[0] for r in block])
        if made.n_terms == 0:
            continue
        queries = spark.sparkContext.broadcast(made)
        counts = texts.select("text").mapInArrow(_counted(queries), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        counts = counts.toArrow()  # one row for each term of the block, two besides
        by_term = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
        n_texts, n_terms = by_term.pop(-1, 0), by_term.pop(-2, 0)
        if n_terms == 0:
            break
        weights = np.zeros(made.n_terms, dtype=np.int64)
        for term, df in by_term.items():
            weights[term] = math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df + 1)))
        scored = texts.mapInArrow(_scored(queries, spark.sparkContext.broadcast(weights), n_texts, n_terms, k), "item bigint, doc_id bigint, score bigint")
        scored = scored.withColumn("item", F.col("item") + first)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = numbered.select("item_id", F.col("_rank").alias("item"))
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH said AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS texts, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, texts),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * texts) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {BEST}
"""
