"""Token ids of a corpus in compressed files, by a static range asymmetric numeral system.

File format: a folder of Parquet files of rows (``FILE``), written by Spark's committer, and so whole or absent. A
file is a range of documents in doc_id order. A row is a segment of it: a frequency table and the blocks that
share it, each of whole documents, decoding on its own, with the number of ids in the file before the
segment. A block's ids are dealt to ``lanes`` interleaved coders, one id to each in turn, so all lanes step
together. Checkpoints hold the lanes' states and the place in the word stream every ``stride`` steps, so that
long blocks can be decoded from several places at once; checksums cover the payload and the ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadymap.llm import byte_bpe
from steadymap.llm.common import Stage
from steadymap.llm.library_slices import shared_coder

BITS = 20  # frequencies of a table sum to 1 << BITS
LOW = 31  # a lane's state is at least 1 << LOW
HEAD, HEAD_SIZE = "<IIIII", 20
FILE = "file long, segment int, docs long, ids long, inside long, payload binary, crc long"


@dataclass(frozen=True)
class Settings:
    end: int = 2
    block: int = 1 << 17
    lanes: int = 1024
    stride: int = 64
    segment: int = 1 << 21
    file_bytes: int = 48 << 20


class Table:
    """Frequencies of a file's ids, scaled so that every id present has at least one share."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        total, size = counts.sum(), 1 << BITS
        freq = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0).astype(np.int64)
        over = int(freq.sum()) - size
        while over > 0:  # too many ids got their least share: the largest give
            top = np.argsort(-freq, kind="stable")[: max(1, min(over, int((freq > 1).sum())))]
            give = np.minimum(freq[top] - 1, max(1, over // len(top)))
            give = np.where(np.cumsum(give) <= over, give, 0)
            if not give.any():
                give[0] = min(over, int(freq[top[0]]) - 1)
            freq[top] -= give
            over -= int(give.sum())
        if total:
            freq[int(freq.argmax())] -= over
        return cls(freq)

    def dump(self) -> bytes:
        used = np.flatnonzero(self.freq)
        return struct.pack("<I", len(used)) + zlib.compress(used.astype("<u2").tobytes() + self.freq[used].astype("<u4").tobytes())

    @classmethod
    def load(cls, raw: bytes) -> Table:
        n, = struct.unpack_from("<I", raw)
        data = zlib.decompress(raw[4:])
        freq = np.zeros(1 << 16, np.uint64)
        freq[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<u4", n, 2 * n)
        return cls(freq)

    def slots(self) -> np.ndarray:
        """The id of every share."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int, stride: int) -> bytes:
    """One block. The last id is coded first, so that decoding runs forward."""
    n, steps = len(ids), -(-len(ids) // lanes)
    state = np.full(lanes, 1 << LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    words, marks, written = [], [], 0
    limit, low, bits = np.uint64(LOW - BITS + 32), np.uint64(32), np.uint64(BITS)
    for step in range(steps - 1, -1, -1):
        f, s = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= (f << limit)
        if full.any():
            out = x[full].astype("<u4")[::-1]
            words.append(out)
            written += len(out)
            x = np.where(full, x >> low, x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + s
        if step % stride == 0:
            marks.append((step, written, state.copy()))
    marks.reverse()
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    head = struct.pack(HEAD, n, lanes, stride, len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    # a checkpoint's place counts from the end the coder started at
    index = b"".join(struct.pack("<I", written - at) + x.astype("<u8").tobytes() for _, at, x in marks)
    return head + index + stream.astype("<u4").tobytes()


def decode(raw: bytes, table: Table, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or of its checkpoints ``first`` up to ``last``."""
    n, lanes, stride, size, check = struct.unpack_from(HEAD, raw)
    steps = -(-n // lanes)
    marks = -(-steps // stride)
    entry = 4 + 8 * lanes
    stream = np.frombuffer(raw, "<u4", size, HEAD_SIZE + marks * entry)
    out = np.empty(n, np.uint16)
    low, bits, mask = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)
    begin, end = first * stride, steps if last is None else min(steps, last * stride)
    if begin < end:
        at, = struct.unpack_from("<I", raw, HEAD_SIZE + first * entry)
        state = np.frombuffer(raw, "<u8", lanes, HEAD_SIZE + first * entry + 4).copy()
    for step in range(begin, end):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        ids = slots[slot]
        out[step * lanes : step * lanes + width] = ids
        x = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        need = np.flatnonzero(x < np.uint64(1 << LOW))
        if len(need):
            x[need] = (x[need] << low) | stream[at : at + len(need)]
            at += len(need)
        state[:width] = x
    if first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != check:
        raise ValueError("the ids of a block do not match their checksum")
    return out[begin * lanes : min(n, end * lanes)]


def write(docs: DataFrame, vocabulary: str, path: str, settings: Settings = Settings()) -> None:
    """Encode every whole text, end it with ``end`` and write the files, in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    table = docs.sparkSession.sparkContext.broadcast(byte_bpe.classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, segment, inside = shared_coder(vocabulary, byte_bpe.Settings(store=600_000), table.value), TaskContext.get().partitionId(), 0, 0
        end = np.array([settings.end], "<u2").tobytes()
        docs: list[tuple] = []
        parts: list[bytes] = []
        held = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.ids(batch.column(1).to_pylist())):
                parts.append(ids + end)
                docs.append((doc, len(parts[-1]) // 2))
                held += docs[-1][1]
                if held >= settings.segment:
                    yield _segment(number, segment, inside, docs, parts, settings)
                    segment, inside, held, docs, parts = segment + 1, inside + held, 0, [], []
        if docs:
            yield _segment(number, segment, inside, docs, parts, settings)

    parts = max(1, -(-size // settings.file_bytes))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def _segment(file: int, segment: int, inside: int, docs: list[tuple], parts: list[bytes], settings: Settings) -> pa.RecordBatch:
    """A row: the shared table, then per block the sizes of its two halves, its documents and its coded ids."""
    ids = np.frombuffer(b"".join(parts), "<u2")
    table = Table.of(np.bincount(ids, minlength=1 << 16))
    head = table.dump()
    out, at, first = [struct.pack("<I", len(head)), head], 0, 0
    while first < len(docs):
        last, size = first, 0
        while last < len(docs) and (not size or size + docs[last][1] <= settings.block):
            size += docs[last][1]
            last += 1
        own = zlib.compress(np.array([(d if d is not None else 0, d is None, n) for d, n in docs[first:last]], "<i8").tobytes())
        coded = encode(ids[at : at + size], table, settings.lanes, settings.stride)
        out += [struct.pack("<II", len(own), len(coded)), own, coded]
        at, first = at + size, last
    raw = b"".join(out)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["file", "segment", "docs", "ids", "inside", "payload", "crc"]
    values = (file, segment, len(docs), len(ids), inside, raw, zlib.crc32(raw))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)


def unpack(payload: bytes, crc: int) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Per block of a segment: (doc_id, number of ids) of its documents, and all their ids."""
    if zlib.crc32(payload) != crc:
        raise ValueError("a segment does not match its checksum")
    size, = struct.unpack_from("<I", payload)
    table, at = Table.load(payload[4 : 4 + size]), 4 + size
    slots = table.slots()
    while at < len(payload):
        a, b = struct.unpack_from("<II", payload, at)
        docs = np.frombuffer(zlib.decompress(payload[at + 8 : at + 8 + a]), "<i8").reshape(-1, 3).tolist()
        yield [(None if none else d, n) for d, none, n in docs], decode(payload[at + 8 + a : at + 8 + a + b], table, slots)
        at += 8 + a + b


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(FILE).parquet(path)
    # one number per file of about file_bytes: the documents before a file
    sizes = sorted(tuple(r) for r in files.groupBy("file").agg(F.sum("ids")).collect())
    before, total = {}, 0
    for file, n in sizes:
        before[file], total = total, total + n
    offsets = spark.createDataFrame(list(before.items()) or [(-1, 0)], "file long, before long")
    # payloads stay where they are: Spark broadcasts the few offsets if they are small
    placed = files.join(offsets, "file").select("payload", "crc", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, crc, start in zip(*(batch.column(c) for c in ("payload", "crc", "start"))):
                start = start.as_py()
                for docs, ids in unpack(payload.as_py(), crc.as_py()):
                    wide, at, out = ids.astype("<u4"), 0, []
                    for doc, n in docs:
                        out.append((doc, start + at, n, zlib.crc32(wide[at : at + n])))
                        at += n
                    start += at
                    doc, begin, n, check = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(check, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """Write the files to the shared folder and read them back.

    A null text is empty and has only its end. Rows with the same doc_id come in the order of their texts, rows
    without one come first. An empty table gives no files' rows and no rows. Other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "rans")
    path = f"{stage.root}/tokens"
    write(docs, vocabulary, path, settings)
    return read(docs.sparkSession, path)
