"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Words are runs of word characters, lower-cased.  A window's SimHash takes, for each of 64
bits, the sign of the sum over its words' hash bits; running sums give every window of
every size in one pass.  Item sizes are classed (steps of at most a tenth), an item is
fingerprinted over as many words as the smallest item of its class has, and each document
is cut into all windows of those sizes.  Fingerprints within ``RADIUS`` bits share one of
four 16-bit blocks up to one bit, so tables of such blocks find all of them.

No radius follows from a similarity, so a second table closes what fingerprints miss: a run
of words similar by 0.8 shares at least 0.8 of the item's weight, so it holds one of any
shingles that make up more than 0.2 of it; the rarest ones of each item are looked up.  A
candidate is verified over all runs of words of the text, shorter and longer than the item
too, by the weighted Jaccard similarity of five-word shingles (weight: rarity among all
items), at least 0.8.

Items are a stated query set: they are taken in blocks of bounded size, each compared with
all documents.

Defined cases: a null or empty text or item matches nothing; an item of fewer than five
words is one shingle, and needs at least ``LEAST_WORDS`` words to be searched for (shorter
ones occur in clean text); an item may occur several times in a document and is reported
once, at its best run of words (the first on a tie); repeated rows are each reported; repeated
items are reported under each id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import documents, letter_words, pick, shingle_hashes, table, text_batches

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 7
STEP = 1.1
LEAST_WORDS = 3
ITEM_BLOCK = 20_000
ROUNDING = 1e-9
BLOCK_WORDS = 32_768
HIT = "doc_id bigint, item_id bigint, position bigint, similarity double"


# The eight bits of a byte as 16-bit counters, four to a number.
_BYTE_LANES = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.uint16).view(np.uint64)


def lanes(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash as 16-bit counters, four to a number: 16 rows of numbers."""
    split = hashes.astype("<u8").view(np.uint8)
    return np.ascontiguousarray(_BYTE_LANES.take(split, axis=0).reshape(-1, 16).T)


def running(counted: np.ndarray) -> np.ndarray:
    """Sums of the counters up to each word, one row per word and a zero row first.

    Counters hold up to 65,535 words, so no sum spills into its neighbour.
    """
    sums = np.zeros((counted.shape[1] + 1, 16), dtype=np.uint64)
    sums[1:] = np.cumsum(counted, axis=1, dtype=np.uint64).T
    return sums


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words: bits set in more than half of them."""
    counts = (sums[size:] - sums[:-size]).view(np.uint16)
    return np.packbits((counts > size // 2).ravel(), bitorder="little").view(np.uint64)


class ItemIndex:
    """The items of one block: size classes, Hamming block tables, shingles and weights."""

    def __init__(self, items: list[tuple[int, str]], common: tuple[np.ndarray, np.ndarray, int] | None = None):
        """``common``: shingles of several items, in how many, and the number of all items; by default of these."""
        hashes, ends = letter_words([t for _, t in items])
        hashed = np.split(hashes, ends[:-1]) if len(items) else []
        kept = [(i, h) for (i, _), h in zip(items, hashed) if len(h) >= LEAST_WORDS]
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        hashed = [h for _, h in kept]
        self.sizes = np.array([len(h) for h in hashed], dtype=np.int64)
        shingled = [np.unique(shingle_hashes(h, WIDTH), return_counts=True) for h in hashed]
        if common is None:
            every, df = np.unique(np.concatenate([s for s, _ in shingled] or [np.zeros(0, np.uint64)]), return_counts=True)
            common = every, df, len(kept)
        # a shingle of one item weighs as much as one of none
        self.every, df, n = common
        self.weight = 1.0 + np.log(max(1, n) / np.maximum(df, 1))
        self.most = 1.0 + np.log(max(1, n))
        self.shingles = [(s, c, self.weights(s)) for s, c in shingled]
        rare = []
        for m, (t, c, w) in enumerate(self.shingles):
            order = np.argsort(-w, kind="stable")
            sums = np.cumsum((c * w)[order])
            least = int(np.searchsorted(sums, (1 - SIMILARITY) * sums[-1] + ROUNDING, side="right")) + 1
            rare += [(x, m) for x in t[order[:least]]] if self.sizes[m] >= WIDTH else []
        rare.sort()
        self.rare = np.array([x for x, _ in rare], dtype=np.uint64)
        self.rare_of = np.array([m for _, m in rare], dtype=np.int64)
        self.may = np.zeros(1 << 22, dtype=bool)
        self.may[self.rare & np.uint64(len(self.may) - 1)] = True
        self.classes = []
        order = np.argsort(self.sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(self.sizes[order[at]])
            end = int(np.searchsorted(self.sizes[order], size * STEP, side="right"))
            members = order[at:end]
            prints = np.array(
                [simhashes(running(lanes(hashed[m][:size])), size)[0] for m in members],
                dtype=np.uint64,
            )
            near = np.zeros((4, 65536), dtype=bool)
            for k, block in enumerate(prints.view(np.uint16).reshape(-1, 4).T):
                for flip in (0, *(1 << b for b in range(16))):
                    near[k, block ^ np.uint16(flip)] = True
            self.classes.append((size, members, prints, near))
            at = end

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.every):
            return np.zeros(len(shingles))
        at = np.minimum(np.searchsorted(self.every, shingles), len(self.every) - 1)
        return np.where(self.every[at] == shingles, self.weight[at], self.most)

    def best(self, item: int, run: Run) -> tuple[float, int] | None:
        """Best (similarity, -shingle) of an item over all runs of a text's shingles.

        Shingles at the ends of a run that the item does not have only lower it, so runs
        begin and end at shared ones; none weighs more than the item over ``SIMILARITY``.
        """
        t, c, w = self.shingles[item]
        total = float((c * w).sum())
        low, high = np.searchsorted(run.ordered, t, side="left"), np.searchsorted(run.ordered, t, side="right")
        if (np.minimum(high - low, c) * w).sum() < SIMILARITY * total - ROUNDING:
            return None
        place = np.concatenate([run.order[a:b] for a, b in zip(low, high)])
        kind = np.repeat(np.arange(len(t)), high - low)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        by = np.argsort(place)
        place, kind, nth = place[by], kind[by], nth[by]
        sums = run.sums(self)
        ends = np.searchsorted(sums[place + 1], sums[place] + total / SIMILARITY + ROUNDING, side="right")
        before = np.zeros(len(t), dtype=np.int64)
        found = None
        for i in range(len(place)):
            k = kind[i : ends[i]]
            both = np.cumsum((nth[i : ends[i]] - before[k] < c[k]) * w[k])
            before[kind[i]] += 1
            if not len(both) or both[-1] < SIMILARITY * total - ROUNDING:
                continue
            like = both / (sums[place[i : ends[i]] + 1] - sums[place[i]] + total - both)
            top = float(like.max())
            if top >= SIMILARITY - ROUNDING and (found is None or top > found[0] + ROUNDING):
                found = min(top, 1.0), -int(place[i])
        return found

    def search(
        self, words: np.ndarray, ends: np.ndarray
    ) -> dict[tuple[int, int], tuple[float, int]]:
        """Best (similarity, -word) for each (text, item), from the hashed words of all texts."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        if not self.classes or not len(words):
            return found
        longest = max(c[0] for c in self.classes)
        starts = np.concatenate([[0], ends[:-1]])
        shingles = shingle_hashes(words, WIDTH) if len(words) >= WIDTH else np.zeros(0, np.uint64)
        pairs = self._sharing(shingles, ends)
        for low in range(0, len(words), BLOCK_WORDS):
            part = words[low : low + BLOCK_WORDS + longest - 1]
            sums = running(lanes(part))
            for size, members, prints, near in self.classes:
                if len(part) < size:
                    continue
                windows = simhashes(sums, size)[:BLOCK_WORDS]
                block = windows.view(np.uint16).reshape(-1, 4)
                hit = near[0].take(block[:, 0])
                for k in (1, 2, 3):
                    hit |= near[k].take(block[:, k])
                where = np.flatnonzero(hit)
                text = np.searchsorted(ends, where + low, side="right")
                where = where[where + low + size <= ends[text]]
                # in steps, so that the table of candidates stays small
                for at in range(0, len(where), max(1, 4_000_000 // len(prints))):
                    some = where[at : at + max(1, 4_000_000 // len(prints))]
                    close = np.bitwise_count(windows[some][:, None] ^ prints[None, :]) <= RADIUS
                    for w, m in zip(*np.nonzero(close)):
                        begin, item = int(some[w]) + low, int(members[m])
                        d = int(np.searchsorted(ends, begin, side="right"))
                        size_of = int(self.sizes[item])
                        if size_of >= WIDTH:
                            pairs.add((d, item))
                        elif begin + size_of <= ends[d] and shingle_hashes(words[begin : begin + size_of], WIDTH)[0] == self.shingles[item][0][0]:
                            found.setdefault((d, item), (1.0, int(starts[d]) - begin))
        last = None
        for d, item in sorted(pairs):
            if d != last:
                last, run = d, Run(shingles[starts[d] : max(starts[d], ends[d] - WIDTH + 1)])
            best = self.best(item, run)
            if best is not None:
                found[d, item] = best
        return found

    def _sharing(self, shingles: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) where the text has a rare shingle of the item."""
        where = np.flatnonzero(self.may.take((shingles & np.uint64(len(self.may) - 1)).astype(np.int64)))
        low, high = (np.searchsorted(self.rare, shingles[where], side=side) for side in ("left", "right"))
        text = np.searchsorted(ends, where, side="right")
        held = (high > low) & (where + WIDTH <= ends[np.minimum(text, len(ends) - 1)])
        return {(int(d), int(m)) for d, a, b in zip(text[held], low[held], high[held]) for m in self.rare_of[a:b]}


class Run:
    """The shingles of one text, in order of their hashes too, and the running sums of their weights."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.order = np.argsort(shingles, kind="stable")
        self.ordered = shingles[self.order]
        self._sums = None

    def sums(self, index: ItemIndex) -> np.ndarray:
        if self._sums is None:
            self._sums = np.concatenate([[0.0], np.cumsum(index.weights(self.shingles))])
        return self._sums


def _scan(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 2_000_000):
            found = index.search(*letter_words(texts))
            if not found:
                continue
            doc = batch.column(0).cast(pa.int64()).to_pylist()
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc[d] for d, _ in keys], pa.int64()),
                    pa.array([int(index.ids[m]) for _, m in keys], pa.int64()),
                    pa.array([-found[k][1] for k in keys], pa.int64()),
                    pa.array([found[k][0] for k in keys], pa.float64()),
                ],
                names=["doc_id", "item_id", "position", "similarity"],
            )

    return run


def item_blocks(items: DataFrame, most: int = ITEM_BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most`` rows, equal texts in one block."""
    rows = pick(items, "item_id", "text").filter("item_id IS NOT NULL AND length(text) > 0")
    n = max(1, -(-rows.count() // most))
    for k in range(n):
        yield [(r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def common_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that several of all items have, in how many, and the number of items."""
    rows = pick(items, "item_id", "text").filter("item_id IS NOT NULL AND length(text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            hashes, ends = letter_words(texts)
            hashed = [h for h in np.split(hashes, ends[:-1]) if len(h) >= LEAST_WORDS]
            own = np.concatenate([np.unique(shingle_hashes(h, WIDTH)) for h in hashed] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.ones(len(own), bool))], names=["shingle", "held"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hashed), pa.int64()), pa.array(np.zeros(len(hashed), bool))], names=["shingle", "held"])

    counts = rows.mapInArrow(run, "shingle bigint, held boolean").groupBy("held", "shingle").agg(F.count(F.lit(1)).alias("n"))
    got = counts.filter("n > 1 OR NOT held").toArrow()
    shingle, n = got.column("shingle"), got.column("n").to_numpy()
    held = got.column("held").to_numpy().astype(bool)
    every = shingle.fill_null(0).to_numpy().view(np.uint64)[held]
    order = np.argsort(every)
    return every[order], n[held][order], int(n[~held].sum())


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, position (in words), similarity of every item found in a text."""
    texts = pick(docs, "doc_id", "text")
    out = None
    common = common_shingles(items)
    for block in item_blocks(items):
        hits = texts.mapInArrow(_scan(ItemIndex(block, common)), HIT)
        out = hits if out is None else out.unionByName(hits)
    return out


def op10_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
