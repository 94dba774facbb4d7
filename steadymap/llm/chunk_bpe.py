"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last bytes cuts a text at spaces where it hits a pattern, so equal passages give equal
chunks wherever they stand. A task encodes each distinct chunk once while its store holds it and writes a
document's ids as those of its chunks. Every join is then checked: the words around it are encoded together
by the library, more of them until the result agrees with what stands there; should it never agree, the
two chunks are encoded as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadymap.llm.pieces import WordEncoder


@dataclass(frozen=True)
class Settings:
    """Chunks average ``1 << bits`` words; ``store`` chunks and ``joins`` checked joins are kept at a time."""

    window: int = 16
    bits: int = 6
    store: int = 60_000
    joins: int = 100_000


def cuts(raw: bytes, settings: Settings) -> list[int]:
    """Places of the spaces that end a chunk."""
    data = np.frombuffer(raw, np.uint8)
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces >= settings.window]
    h = np.zeros(len(spaces), np.uint32)
    for k in range(1, settings.window + 1):  # a polynomial hash of the bytes before each space
        h = h * np.uint32(0x01000193) + data[spaces - k]
    h *= np.uint32(0x9E3779B1)
    return spaces[h >> np.uint32(32 - settings.bits) == 0].tolist()


class ChunkEncoder:
    def __init__(self, vocabulary: str, settings: Settings = Settings()):
        self.words, self.settings = WordEncoder(vocabulary), settings
        self.store: dict[bytes, bytes] = {}
        self.agreed: set[tuple[str, str]] = set()
        self.encoded = self.reused = self.repaired = 0
        size = self.words.tokenizer.get_vocab_size()
        self.numbers = [str(k) for k in range(size)]
        self.tokens = [self.words.tokenizer.id_to_token(k) or "" for k in range(size)]

    def chunk(self, raw: bytes) -> bytes:
        key = hashlib.blake2b(raw, digest_size=16).digest()
        ids = self.store.get(key)
        if ids is None:
            ids = self.words.encode(raw.decode())
            if len(self.store) >= self.settings.store:
                self.store.clear()
            self.store[key] = ids
            self.encoded += 1
        else:
            self.reused += 1
        return ids

    def joins(self, left: bytes, right: bytes) -> bool:
        """Whether the ids of two chunks stand side by side as in the joined text."""
        size = 1
        while True:
            a, b = left.decode().split()[-size:], right.decode().split()[:size]
            if (pair := (" ".join(a), " ".join(b))) in self.agreed:
                return True
            if self.words.whole(" ".join(pair)) == self.words.encode(pair[0]) + self.words.encode(pair[1]):
                if len(self.agreed) >= self.settings.joins:
                    self.agreed.clear()
                self.agreed.add(pair)
                return True
            if len(a) < size and len(b) < size:
                return False
            size *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as the library gives them."""
        raw, at, parts = text.encode(), 0, []
        for cut in cuts(raw, self.settings):
            parts.append(raw[at:cut])
            at = cut + 1
        parts.append(raw[at:])
        out: list[bytes] = []
        last = None
        for part in parts:
            if last is not None and part.strip() and last.strip() and not self.joins(last, part):
                self.repaired += 1
                last = last + b" " + part
                out[-1] = self.words.whole(last.decode())
            else:
                out.append(self.chunk(part))
                last = part
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives for a tokenizer without a decoder: tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[k] for k in ids])


def encode(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id and ``ids`` of every whole text; a null text is empty and has none.

    Repeated rows are encoded once each, an empty table gives no rows, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(vocabulary, settings)
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t.as_py() or ""), "<u2").astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(vocabulary, settings)
        numbers = coder.numbers
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = np.frombuffer(coder.encode(t.as_py() or ""), "<u2").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([numbers[k] for k in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
