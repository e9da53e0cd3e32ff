"""Small helpers shared by the text operators."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: whatever else a table carries cannot clash with working columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole_rows(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``_all`` beside working columns, so none can clash; ``_all.*`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), *[c.alias(n) for n, c in keys.items()])


MOST_BITS = 24


def split_by_keys(rows: DataFrame, key: str, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among the ``n`` of ``wanted``, and those whose key surely is not.

    A table with some 16 bits for each wanted key, 2 MB at most, is broadcast; with more keys it
    is denser, and more rows may be among them.  So where few keys are asked about, few rows move.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - min(max(6, (16 * n).bit_length()), MOST_BITS))
    word, bit = F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.join(F.broadcast(words), word == F.col("_word"), "left")
    may = F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))
    return met.filter(may).drop("_word", "_bits"), met.filter(~may).drop("_word", "_bits")


def globally_numbered(df: DataFrame, order: Sequence[str | Column], work: Workspace, label: str) -> tuple[DataFrame, int]:
    """``_rank`` = 0, 1, ... over all rows in the given order, and the number of rows.

    The rows are range-sorted and written; the id of a row within its task plus the number
    of rows in the tasks before it is its rank.  Only one row per task meets in one place.
    """
    names = df.columns
    sorted_rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = work.save(sorted_rows, label)
    rows = stored.df()
    piece = F.shiftright("_at", 33)
    sizes = work.save(rows.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n")), f"{label}-sizes").df()
    from pyspark.sql import Window

    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = (
        rows.withColumn("_piece", piece)
        .join(F.broadcast(offsets), "_piece")  # one row per task of the sort
        .withColumn("_rank", F.col("_offset") + F.col("_at") - F.shiftleft(F.col("_piece"), 33))
    )
    return numbered.select(*names, "_rank"), stored.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _places(n: int) -> np.ndarray:
    """Multipliers by place in a word, as many as the longest word needs."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def run_hashes(coded: np.ndarray, inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs where ``inside``, and their running ends by text.

    ``coded``: a 64-bit code of each symbol.  ``ends``: running ends of the texts in symbols;
    the last symbol of each text must be outside, so no run crosses texts.
    """
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    lengths = stops - starts
    place = np.arange(starts[0], len(coded), dtype=np.int64)
    place -= np.repeat(starts, np.diff(starts, append=len(coded)))
    np.minimum(place, lengths.max(), out=place)
    terms = _places(int(lengths.max()) + 1).take(place)
    terms *= coded[starts[0] :]
    terms *= inside[starts[0] :]
    hashes = mix(np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, ends)


_BYTE_CODE = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1))
_BYTE_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and running ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return run_hashes(_BYTE_CODE.take(data), _BYTE_WORD.take(data), ends)


@functools.cache
def _word_characters() -> np.ndarray:
    """Which code points are letters, digits or the underscore."""
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of word characters of all texts, lower-cased, and running ends."""
    low = [t.lower() if t else "" for t in texts]
    data = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    coded = (data + np.uint32(1)) * np.uint64(0xD6E8FEB86659FD93)
    coded ^= coded >> np.uint64(32)
    return run_hashes(coded, _word_characters().take(data), ends)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : n - width + 1 + k] + np.uint64(k + 1 + 97 * width))
    return out


def least_type(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold them; ``in_least`` reads them back."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def in_least(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}" if n else "<u1")


def bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets of sorted 64-bit keys, their first ``bits`` bits, begin and the last ends."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, starts), len(keys))


def packed_keys(keys: np.ndarray, bucket: int, bits: int) -> bytes:
    """Sorted keys of one bucket as differences of as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(bucket << 64 - bits)).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data: bytes, n: int, bucket: int, bits: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(bucket << 64 - bits)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of bounded text size, each with its texts; one long text stands alone."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if size and size + n > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]
