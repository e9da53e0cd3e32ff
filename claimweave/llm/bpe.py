"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every match of the splitting pattern is encoded on its own.  A piece met before is looked
up; new pieces go to the library, whose byte alphabet (one printable character per byte)
is reversed for decoding.  Offsets are given in bytes and in characters: a token that ends
inside a character covers that character from its first to its last byte.

Defined cases: a null text is an empty one; an empty text has no tokens and decodes to no
bytes; texts of any length are encoded whole; strings of special tokens are ordinary text;
ids that end inside a character decode to exact bytes, and to U+FFFD as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm.common import documents, pick, text_batches

REMEMBERED = 300_000
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id bigint, ids array<int>, byte_ends array<bigint>, char_starts array<bigint>, char_ends array<bigint>"


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte: printable Latin-1 bytes stand for themselves, the rest
    follow from U+0100 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


class ByteBpe:
    """Encoder and decoder over one vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.model = self.library.model
        self.split = regex.compile(pattern).findall
        table = byte_alphabet()
        self.printable = str.maketrans({chr(b): c for c, b in table.items()})
        special = {i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.bytes_of = {
            i: t.encode() if i in special else bytes(table[c] for c in t) for t, i in self.library.get_vocab().items()
        }
        self.pieces: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces not met yet, each as one run of mapped bytes."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        for p in pieces:
            if p not in self.pieces:
                mapped = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.printable)
                self.pieces[p] = tuple([t.id for t in self.model.tokenize(mapped)])

    def encode(self, text: str | None) -> list[int]:
        parts = self.split(text or "")
        self.learn(set(parts))
        return list(chain.from_iterable(map(self.pieces.__getitem__, parts)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int], list[int]]:
        """End byte of each token, and the first and last-plus-one character it touches."""
        import numpy as np

        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ends.tolist(), char_of[starts].tolist(), (char_of[ends - 1] + 1).tolist()


def _encoder(vocabulary: str, pattern: str) -> ByteBpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(vocabulary, pattern)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(vocabulary, pattern)
        known: dict[str, tuple[int, str, bytes]] = {}
        for batch, texts in text_batches(batches, "text"):
            rows = []
            for text in texts:
                parts = bpe.split(text or "")
                if len(known) > REMEMBERED:
                    known.clear()
                new = [p for p in set(parts) if p not in known]
                bpe.learn(new)
                for p in new:
                    ids = bpe.pieces[p]
                    known[p] = (len(ids), " ".join(map(str, ids)), bpe.decode(ids))
                found = list(map(known.__getitem__, parts))
                ids_text = " ".join([f[1] for f in found])
                rows.append((
                    sum([f[0] for f in found]),
                    hashlib.sha256(ids_text.encode()).hexdigest(),
                    hashlib.sha256(b"".join([f[2] for f in found])).hexdigest(),
                ))
            ids = batch.column(0).cast(pa.int64())
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, OUT)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: token ids with byte ends and character spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(vocabulary, pattern)
        for batch, texts in text_batches(batches, "text", 1_000_000):
            ids = [bpe.encode(t) for t in texts]
            spans = [bpe.offsets(t or "", i) for t, i in zip(texts, ids)]
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), *[pa.array([s[k] for s in spans], long) for k in range(3)]],
                names=["doc_id", "ids", "byte_ends", "char_starts", "char_ends"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, FULL)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, ids): the exact bytes and the text they spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(vocabulary, pattern)
        for batch in batches:
            raw = [bpe.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary()), pa.array([r.decode(errors="replace") for r in raw], pa.string())],
                names=["doc_id", "bytes", "text"],
            )

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary, text string")


def vocabulary_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *vocabulary_file())
