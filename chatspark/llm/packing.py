"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many
whole pieces of the maximum length as fit, then the binary digits of the rest,
longest first. Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding; pieces of equal length form a bucket.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries of each of the two generations of a worker's chunk cache
CACHE_ENTRIES = 500_000

#: from here on lower case and composition may depend on the context
_BEYOND_LATIN = re.compile("[\u0130-\U0010ffff]")
_LETTER_THEN_SIGN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff])([!-/:-@\[-`{-~])")

PIECES = "start long, length long, doc_tokens long, ids binary"


class ChunkEncoder:
    """Encodes whole texts through a cache of their chunks.

    The tokenizer's normaliser and pre-tokenizer never look across a space, so
    a text's ids are those of its chunks in a row. Latin texts are also put
    into lower case and cut between a letter and a sign first, which the
    tokenizer does anyway: that leaves fewer different chunks. Ids are
    little-endian unsigned 32-bit numbers."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        text = text or ""
        if "<|" not in text and not _BEYOND_LATIN.search(text):
            text = _LETTER_THEN_SIGN.sub(r"\1 \2", text.lower())
        return text.replace("\n", " ").split(" ")

    def _learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        new = []
        for c in chunks.difference(self.known):
            ids = self.older.get(c)
            if ids is None:
                new.append(c)
            else:
                self.known[c] = ids
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[c] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None], end: bytes) -> Iterator[bytes]:
        for lo in range(0, len(texts), 256):
            chunks = [self.chunks(t) for t in texts[lo:lo + 256]]
            self._learn(set().union(*chunks))
            known = self.known
            for cs in chunks:
                yield b"".join([known[c] for c in cs]) + end


_ENCODERS: dict[int, ChunkEncoder] = {}


def _encoder(spec: str) -> ChunkEncoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(spec)
    return _ENCODERS[key]


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``longest`` is a power of two."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def decompose(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
              max_length: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: id, start (ids of the document before it), length,
    doc_tokens (with the end id), ids (little-endian unsigned 32-bit numbers),
    bucket (log2 of the length) and sequence_id.

    A null or empty text has the end id alone: one piece of length 1. Repeated
    rows are packed once each; an empty table gives no rows; other columns are
    ignored. No shuffle: sequence_id numbers the pieces by scan partition and
    row, which a task that is run again repeats. The vocabulary file is read
    on the driver (a few MB) and sent with the task."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        encoder = _encoder(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, texts = batch.column(0).slice(lo, 512), batch.column(1).slice(lo, 512).to_pylist()
                row, start, length, total, data = [], [], [], [], []
                for k, raw in enumerate(encoder.encode(texts, end)):
                    n = len(raw) // 4
                    for a, size in binary_pieces(n, max_length):
                        row.append(k)
                        start.append(a)
                        length.append(size)
                        total.append(n)
                        data.append(raw[4 * a:4 * (a + size)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(data, pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "ids"])

    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(pack, f"id {id_type}, {PIECES}")
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "doc_tokens", "ids",
        F.round(F.log2("length")).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder per length, ready for sampling
    batches of equal length."""
    pieces.write.partitionBy("length").parquet(path)


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces without their ids, with the ids' CRC-32 instead."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket")
