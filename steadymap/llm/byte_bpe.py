"""Byte-level BPE with vectorised pre-tokenisation: whole batches of texts at once, without a regular expression.

Every code point becomes a symbol (its class, and what stands behind it where that matters). A symbol is a
function on eight states of a small automaton, packed into 24 bits; composing functions is associative, so the
state before every code point comes from a tree of compositions over the whole batch. State and symbol say
where a match of the pattern begins. Distinct slices between these places are merged once, all slices of one
length together, and kept in a store; the places are kept too, so any slice can be decoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: Symbols beyond letter, number and other: an apostrophe in front of one or two letters of a contraction, the
#: last of a run of white space before something else (a space or another), and white space before white space or the end.
SHORT, LONG, LAST_SPACE, LAST_WHITE, MORE_WHITE = range(3, 8)
FIRST = 8  # added to the symbol of a text's first code point
#: States: nothing open, in letters, numbers, others, behind a space that the next match takes in, in white space,
#: one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BEHIND_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
#: Fixed values of the pattern: what an apostrophe contracts with.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
NONE = np.int32(1 << 30)


@dataclass(frozen=True)
class Settings:
    """Code points worked on at once, the length from which a text is cut (at a sure boundary), bytes up to which slices are merged together, slices kept."""

    batch: int = 3_000_000
    part: int = 1_000_000
    wide: int = 32
    store: int = 400_000


def classes() -> np.ndarray:
    """The class of every code point, asked of the library whose splits are to be met."""
    import tiktoken

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(points)).decode("utf-8")
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    out[ord(" ")] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a symbol, and whether a match begins there."""
    if symbol >= FIRST:
        state, symbol = FRESH, symbol - FIRST
    if symbol == LETTER:
        after = {ONE_MORE: FRESH, TWO_MORE: ONE_MORE}.get(state, IN_LETTERS)
        return after, state not in (IN_LETTERS, BEHIND_SPACE, ONE_MORE, TWO_MORE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, BEHIND_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        if symbol == OTHER or state in (IN_OTHERS, BEHIND_SPACE):
            return IN_OTHERS, state not in (IN_OTHERS, BEHIND_SPACE)
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == MORE_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (BEHIND_SPACE if symbol == LAST_SPACE else FRESH), True


_STEPS = np.array([[_step(s, x) for x in range(16)] for s in range(8)])
NEXT, BEGINS = _STEPS[:, :, 0].astype(np.uint8).ravel(), _STEPS[:, :, 1].astype(bool).ravel()


@lru_cache(maxsize=1)
def _fours() -> np.ndarray:
    """The packed function of every four symbols in a row."""
    four = np.indices((16, 16, 16, 16)).reshape(4, -1)
    packed = np.zeros(four.shape[1], np.int32)
    for s in range(8):
        state = np.full(four.shape[1], s, np.uint8)
        for x in four:
            state = NEXT[state * 16 + x]
        packed |= state.astype(np.int32) << (3 * s)
    return packed


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Packed functions: first f, then g."""
    out = np.zeros_like(f)
    for s in range(0, 24, 3):
        out |= ((g >> (3 * ((f >> s) & 7))) & 7) << s
    return out


def _before(f: np.ndarray) -> np.ndarray:
    """The state before each of a row of packed functions, when the first one meets FRESH."""
    if len(f) == 1:
        return np.zeros(1, np.int32)
    left, right = f[0::2], f[1::2]
    half = _before(_then(left[: len(right)], right) if len(left) == len(right) else np.append(_then(left[:-1], right), left[-1:]))
    out = np.empty(len(f), np.int32)
    out[0::2] = half
    out[1::2] = ((left >> (3 * half)) & 7)[: len(right)]
    return out


def begins(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where matches begin in texts that lie end to end; ``first`` marks the first code point of each."""
    kind = table[points]
    last = np.append(first[1:], True)
    white = kind >= SPACE
    more = last | np.append(white[1:], False)
    symbol = kind.copy()
    symbol[white] = np.where(more, MORE_WHITE, np.where(kind == SPACE, LAST_SPACE, LAST_WHITE))[white]
    at = np.flatnonzero((points == ord("'")) & ~last)
    one = points[at + 1]
    symbol[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = SHORT
    at, one = at[~last[at + 1]], one[~last[at + 1]]
    two = points[at + 2]
    for a, b in TWO_LETTERS:
        symbol[at[(one == ord(a)) & (two == ord(b))]] = LONG
    symbol += np.uint8(FIRST) * first
    n = len(symbol)
    lanes = np.append(symbol, np.zeros(-n % 4, np.uint8)).reshape(-1, 4)
    wide = lanes.astype(np.int32)
    state = _before(_fours()[((wide[:, 0] * 16 + wide[:, 1]) * 16 + wide[:, 2]) * 16 + wide[:, 3]]).astype(np.uint8)
    out = np.empty(lanes.shape, bool)
    for k in range(4):
        place = state * np.uint8(16) + lanes[:, k]
        out[:, k] = BEGINS[place]
        state = NEXT[place]
    return out.ravel()[:n]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Merger:
    """Merges pairs of a rank file; ids are ranks."""

    def __init__(self, path: str, settings: Settings = Settings()):
        self.settings = settings
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.uint32)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.length, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        blob, at = [], 0
        for token, rank in self.ranks.items():
            self.length[rank], self.start[rank] = len(token), at
            blob.append(token)
            at += len(token)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.numbers = [str(k) for k in range(size)]
        self.store: dict[bytes, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def together(self, pieces: list[bytes]) -> None:
        """Merge pieces of one length: every round merges the first lowest pair of each piece."""
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), -1)
        rank, names = self.rank(ids[:, :-1], ids[:, 1:]), np.arange(len(pieces))
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            low = rank[np.arange(len(ids)), best] if rank.shape[1] else np.full(len(ids), NONE)
            done = low == NONE
            for name, row in zip(names[done].tolist(), ids[done].astype("<u2")):
                self.store[pieces[name]] = row.tobytes()
            if done.all():
                return
            ids, rank, names, best, low = ids[~done], rank[~done], names[~done], best[~done], low[~done]
            row, width = np.arange(len(ids)), ids.shape[1]
            # what lies behind the merged pair moves one place to the left
            take = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids[row, best] = low
            rank = np.take_along_axis(rank, take[:, :-1] + (take[:, :-1] == best[:, None]), 1) if width > 2 else np.empty((len(ids), 0), np.int32)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            rank[left, best[left] - 1] = self.rank(ids[left, best[left] - 1], low[left])
            rank[right, best[right]] = self.rank(low[right], ids[right, best[right] + 1])

    def alone(self, piece: bytes) -> bytes:
        """Merge one piece of any length with a heap of pairs, lowest rank first, then leftmost."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := pairs.get(ids[k] << 16 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or pairs.get(ids[k] << 16 | ids[j]) != r:
                continue
            ids[k], ids[j], after[k] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (x := pairs.get(ids[a] << 16 | ids[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return np.array([x for x in ids if x >= 0], "<u2").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as little-endian 16-bit integers."""
        missing = [p for p in pieces if p not in self.store]
        if len(self.store) + len(missing) > self.settings.store:
            # a full store keeps its older half, as frequent pieces are met early, and what this batch needs of the rest
            kept = dict(islice(self.store.items(), self.settings.store // 2))
            self.store = kept | {p: self.store[p] for p in pieces if p in self.store}
        by_length: dict[int, list[bytes]] = {}
        for p in missing:
            if (r := self.ranks.get(p)) is not None:
                self.store[p] = r.to_bytes(2, "little")
            elif len(p) <= self.settings.wide:
                by_length.setdefault(len(p), []).append(p)
            else:
                self.store[p] = self.alone(p)
        for same in by_length.values():
            self.together(same)
        return [self.store[p] for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, end to end."""
        return self.blob[ranges(self.start[ids], self.length[ids])]


def parts(text: str, size: int) -> list[str]:
    """A long text cut where white space begins, which always begins a match whatever stood before."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in " \n\t" and text[cut - 1] > " " and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


class Coder:
    """Encodes lists of texts; keeps its merged slices for as long as the worker lives."""

    def __init__(self, path: str, table: np.ndarray, settings: Settings = Settings()):
        self.merger, self.table, self.settings = Merger(path, settings), table, settings

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids, and the place in them where each slice begins. None of the texts is empty."""
        whole = "".join(texts)
        raw = whole.encode()
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        first = np.zeros(len(points), bool)
        first[np.cumsum([0, *map(len, texts[:-1])])] = True
        at = np.flatnonzero(begins(points, first, self.table))
        text_at = np.cumsum(first)[at] - 1  # the text of every slice
        if len(raw) > len(points):
            widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(widths) - widths)[at]
        offsets = np.append(at, len(raw)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        code = slices.indices.to_numpy()
        merged = self.merger.merge(slices.dictionary.to_pylist())
        sizes = np.array([len(m) // 2 for m in merged])
        ids = np.frombuffer(b"".join(merged), "<u2")[ranges((np.cumsum(sizes) - sizes)[code], sizes[code])]
        # the places kept for decoding: a slice's bytes and those of its ids have to be the same number
        count, ends = sizes[code], np.cumsum(sizes[code])
        length = self.merger.length[ids]
        if (np.add.reduceat(length, ends - count) != np.diff(offsets)).any():
            raise ValueError("a slice is not what its ids stand for")
        slice_cut = np.searchsorted(text_at, np.arange(1, len(texts)))
        id_cut = (ends - count)[slice_cut]
        return [(i, s - (s[0] if len(s) else 0)) for i, s in zip(np.split(ids, id_cut), np.split(ends - count, slice_cut))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Place of every text, in order, and the ids and slices of its parts; null and empty texts have none."""
        units, size, open_ = [], 0, []

        def flush():
            coded = iter(self.batch([u for u in units if u]) if any(units) else [])
            for place, n in open_:
                yield place, [next(coded) for _ in range(n)]

        for place, text in enumerate(texts):
            cut = parts(text, self.settings.part) if text else []
            units += cut
            size += len(text or "")
            open_.append((place, len(cut)))
            if size >= self.settings.batch:
                yield from flush()
                units, size, open_ = [], 0, []
        yield from flush()


@lru_cache(maxsize=2)
def _shared(path: str, settings: Settings, table: bytes) -> Coder:
    """The coder of a worker process, so that later tasks find the slices of earlier ones."""
    return Coder(path, np.frombuffer(table, np.uint8), settings)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, ids and slices (places in the ids where a match of the pattern begins) of every whole text.

    Null and empty texts have neither. Long texts are worked on in parts. Repeated rows come out as often as they
    come in, ties do not matter, an empty table gives no rows, other columns are ignored.
    """
    table = docs.sparkSession.sparkContext.broadcast(classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _shared(vocabulary, settings, table.value)
        for batch in batches:
            for place, coded in coder.encode(batch.column(1).to_pylist()):
                ids = [i for i, _ in coded]
                before = np.cumsum([0, *map(len, ids)])
                slices = [s + b for (_, s), b in zip(coded, before)]
                join = lambda x: pa.array([np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(place, 1), join(ids), join(slices)], names=["doc_id", "ids", "slices"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, slices array<int>")


def decode(encoded: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id and the bytes (``raw``) that the ids stand for; null ids stand for nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(vocabulary, settings)
        for batch in batches:
            raw = [merger.decode(np.array(ids.as_py() or [], np.int64)).tobytes() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, vocabulary: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; odd rows as in ``encode``."""
    table = docs.sparkSession.sparkContext.broadcast(classes().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _shared(vocabulary, settings, table.value)
        numbers = coder.merger.numbers
        for batch in batches:
            n, a, b = [], [], []
            for _, coded in coder.encode(batch.column(1).to_pylist()):
                written, decoded, size = hashlib.sha256(), hashlib.sha256(), 0
                for ids, _ in coded:
                    text = ",".join([numbers[k] for k in ids.tolist()])
                    written.update(("," + text if size else text).encode())
                    decoded.update(coder.merger.decode(ids))
                    size += len(ids)
                n.append(size)
                a.append(written.hexdigest())
                b.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
