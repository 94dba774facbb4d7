"""Collocations by dynamic itemset counting: phrases of all lengths counted in cyclic scans of shards.

Texts are dealt to shards, which are scanned in a circle, one Spark job a shard. Words are counted from the start.
A longer phrase is activated once its first and its last words, all but one, have both reached the threshold, wherever
in the circle that happens, and is counted until it has seen every shard once. A scan ends a circle for some phrases
while it begins one for others; scans stop when nothing is active.

What has reached the threshold, and in which scan, reaches the tasks as a table of bytes of a fixed size, two places
a phrase. Places shared by chance only activate a phrase that did not have to be counted, never before its parts: its
count is whole as well and below the threshold. The table's size is a parameter, so what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import TO_LOWER, Stage

#: Fixed values of the contract: what ends a piece and what separates words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(ENDS)] = 2
NEVER = 255
ROWS = 1 << 16  # of a batch of phrases, and places looked up at once
FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 1024, np.uint64) | np.uint64(1)
ONE, TWO, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    """``shards`` (at most 50), bits of the number of places, bytes of text a task counts at once, groups a language is ranked in first."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    shards: int = 2
    bits: int = 25
    block: int = 12_000_000
    groups: int = 64


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of every word (non-empty binary values)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * FACTORS[place % len(FACTORS)], offsets[:-1])


def _language(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) + word) * NEXT


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(((h * factor) >> np.uint64(64 - bits)).astype(np.int64) for factor in (ONE, TWO))


def marked_since(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The scan in which a phrase reached the threshold, NEVER if it did not."""
    out = np.empty(len(h), np.uint8)
    for lo in range(0, len(h), ROWS):
        a, b = places(h[lo : lo + ROWS], bits)
        out[lo : lo + ROWS] = np.maximum(table[a], table[b])
    return out


def cut(text: bytes, size: int) -> list[bytes]:
    """A long text in parts that end where a piece ends; no phrase goes over such an end."""
    out, at = [], 0
    while len(text) - at > size:
        end = min((p for p in (text.find(bytes([e]), at + size) for e in ENDS) if p >= 0), default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


class Counter:
    """Counts the phrases of one scan that are active in it."""

    def __init__(self, table: np.ndarray, scan: int, settings: Settings):
        self.table, self.scan, self.settings = table, scan, settings

    def active(self, since: np.ndarray) -> np.ndarray:
        """Whether phrases whose parts have reached the threshold since these scans are counted in this one."""
        begin = since.astype(np.int16) + 1
        return (since != NEVER) & (begin <= self.scan) & (self.scan < begin + self.settings.shards)

    def count(self, languages: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """lang, k, phrase, c; the row with k = 0 has the number of words."""
        names = sorted(set(languages))
        raw = b"\n".join(texts).translate(TO_LOWER)
        kind = KIND[np.frombuffer(raw, np.uint8)]
        word = kind == 0
        # numbers are as narrow as the text allows and go once used: a worker holds one block's at a time
        change = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        edges = np.flatnonzero(change).astype(np.int32)
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        if not len(starts):
            return
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        lang = np.array([names.index(x) for x in languages], np.int32)[text]
        # ends of pieces and beginnings of words, in their order
        ends = (kind == 2)[(kind == 2) | (change[:-1] == 1)]
        piece = np.cumsum(ends, dtype=np.int32)[~ends]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        letters = np.frombuffer(raw, np.uint8)[word]
        del raw, kind, word, change, edges, starts, lengths, text, ends
        words = pa.Array.from_buffers(pa.binary(), len(lang), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        del offsets, letters
        known = words.dictionary
        # a word of a language is one number
        both = lang.astype(np.int64) * len(known) + words.indices.to_numpy()
        count = np.bincount(both, minlength=len(names) * len(known))
        used = np.flatnonzero(count)
        number = np.zeros(len(count), np.int32)
        number[used] = np.arange(len(used))
        w, of_lang, of_word = number[both], used // len(known), used % len(known)
        del both, words, number
        if self.scan < self.settings.shards:
            total = np.bincount(lang, minlength=len(names))
            yield self._rows([names[x] for x in np.flatnonzero(total)], 0, pa.array([b""] * int((total > 0).sum()), pa.binary()), total[total > 0])
            yield self._rows(pa.array(names).take(pa.array(of_lang)), 1, known.take(pa.array(of_word)), count[used])
        del lang, count
        h1 = (word_hashes(known)[of_word] ^ np.array([_language(x) for x in names])[of_lang])[w]
        h, since = h1, marked_since(h1, self.table, self.settings.bits)
        inside, joined = piece[1:] == piece[:-1], None
        for k in range(2, self.settings.longest + 1):
            if len(since) < 2:
                return
            # phrase k at a place: its first words are the phrase k - 1 there, its last words that of the next place
            joined = inside if joined is None else joined[:-1] & inside[k - 2 :]
            parts = np.where(joined, np.maximum(since[:-1], since[1:]), NEVER).astype(np.uint8)
            at = np.flatnonzero(self.active(parts)).astype(np.int32)
            if len(at):
                yield from self._count(at, k, w, len(used), names, of_lang, of_word, known)
            del at
            if k == self.settings.longest:
                return
            possible = np.flatnonzero(parts != NEVER)
            h = _longer(h[:-1], h1[k - 1 :])
            since = np.full(len(parts), NEVER, np.uint8)
            # places marked by chance before its parts must not begin the circle of a longer phrase: its parts are not seen before theirs
            since[possible] = np.maximum(marked_since(h[possible], self.table, self.settings.bits), parts[possible])

    def _count(self, at, k, w, width, names, of_lang, of_word, known) -> Iterator[pa.RecordBatch]:
        levels, key = [], w[at].astype(np.int64)
        for j in range(1, k):
            key *= width
            key += w[j:][at]
            if j < k - 1:
                # numbered by hashing: a search in the sorted keys costs more than the counting
                numbered = pa.array(key).dictionary_encode()
                levels.append(numbered.dictionary.to_numpy())
                key = numbered.indices.to_numpy().astype(np.int64)
                del numbered
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count, keys = np.diff(first, append=len(key)), key[first]
        del key, first
        for lo in range(0, len(keys), ROWS):
            key, columns = keys[lo : lo + ROWS], []
            for level in [*reversed(levels), None]:
                columns.append(key % width)
                key = key // width if level is None else level[key // width]
            columns.append(key)
            columns.reverse()
            parts = [known.take(pa.array(of_word[c])) for c in columns]
            yield self._rows(pa.array(names).take(pa.array(of_lang[columns[0]])), k, pc.binary_join_element_wise(*parts, b" "), count[lo : lo + ROWS])

    @staticmethod
    def _rows(lang, k: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.full(len(count), k, np.int32)), phrase.cast(pa.string()),
                                           pa.array(count.astype(np.int64))], names=["lang", "k", "phrase", "c"])


def scanned(shard: DataFrame, table: np.ndarray, scan: int, settings: Settings):
    """lang, k, phrase, c of the active phrases of a shard, and the broadcast table."""
    # mostly empty places: a small part of the table's size travels
    shared = shard.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(np.frombuffer(zlib.decompress(shared.value), np.uint8), scan, settings)
        languages, texts, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in cut(text.encode(), settings.block):
                    languages.append(lang)
                    texts.append(part)
                    size += len(part)
                    if size >= settings.block:
                        yield from counter.count(languages, texts)
                        languages, texts, size = [], [], 0
        if texts:
            yield from counter.count(languages, texts)

    return shard.select("lang", "text").mapInArrow(run, "lang string, k int, phrase string, c long"), shared


def places_of(found: DataFrame, settings: Settings) -> DataFrame:
    """The different places of phrases (lang, k, phrase); no more than the table has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, out = batch.column(1).to_numpy(), []
            for k in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == k)
                words = [p.split(b" ") for p in batch.column(2).take(pa.array(rows)).cast(pa.binary()).to_pylist()]
                langs = np.array([_language(x) for x in batch.column(0).take(pa.array(rows)).to_pylist()])
                h1 = [word_hashes(pa.array([p[j] for p in words], pa.binary())) ^ langs for j in range(k)]
                h = h1[0]
                for more in h1[1:]:
                    h = _longer(h, more)
                out += places(h, settings.bits)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).astype(np.int32))], names=["place"])

    return found.select("lang", "k", "phrase").mapInArrow(run, "place int").distinct()


def frequent(docs: DataFrame, stage: Stage, settings: Settings = Settings()) -> DataFrame:
    """lang, k, phrase, c of all phrases with ``least`` or more occurrences, and of the words of each language as k = 0."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"),
                        F.pmod(F.xxhash64("doc_id", text, F.lit(7)), F.lit(settings.shards)).cast("int").alias("shard")).where("text <> ''")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(f"{stage.root}/shards")
    shards = spark.read.schema("lang string, text string, shard int").parquet(f"{stage.root}/shards")
    table = np.full(1 << settings.bits, NEVER, np.uint8)
    state, done, scan, last = None, [], 0, 0
    while scan < settings.shards or scan <= last + settings.shards:
        got, shared = scanned(shards.where(F.col("shard") == scan % settings.shards), table, scan, settings)
        rows = got.select("lang", "k", "phrase", "c", F.lit(scan).alias("first"), F.lit(None).cast("int").alias("found"))
        if state is not None:
            rows = rows.unionByName(state)
        total = rows.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c"), F.min("first").alias("first"), F.min("found").alias("found"))
        enough = (F.col("k") == 0) | (F.col("c") >= settings.least)
        # a phrase that was first met now cannot be counted any more after a circle from here
        whole = F.col("first") + settings.shards - 1 <= scan
        now = stage.save_once(total.where(enough | ~whole).withColumn("found", F.coalesce("found", F.when(enough, scan))), f"counts-{scan}")
        shared.destroy()
        done.append(stage.save(now.where(enough & whole), f"done-{scan}"))
        new = places_of(now.where((F.col("found") == scan) & F.col("k").between(1, settings.longest - 1)), settings).toPandas()["place"].to_numpy()
        new = new[table[new] == NEVER]
        if len(new):
            table[new], last = scan, scan
        if scan:
            stage.drop(f"counts-{scan - 1}")
        state, scan = now.where(~whole), scan + 1
    # nothing is active any more: what was first met late in its circle is whole as well
    out = state.where(enough)
    for more in done:
        out = out.unionByName(more)
    # the words of a language may have ended their circles in different scans
    return stage.save(out.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")), "frequent")


def _slices(words: Column, shortest: Column, longest: Column) -> Column:
    """All runs of ``shortest`` to ``longest`` words, joined by spaces."""
    runs = F.transform(F.sequence(shortest, longest), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.array_join(F.slice(words, at, n), " ")))
    return F.array_distinct(F.flatten(runs))


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Null languages are ``und``, null texts are empty. Ties go to more occurrences, then to the phrase in byte order.
    Repeated rows count as often as they come in; long texts are counted in parts that end with a piece. An empty
    table gives no rows; other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "phrases")
    found = frequent(docs, stage, settings)
    again = lambda: stage.again("frequent", found)
    words = F.split("phrase", " ", -1)
    longer = again().where("k >= 3").select("lang", F.col("c").alias("longer"), F.explode(_slices(words, F.lit(2), F.col("k") - 1)).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = again().where("k >= 2").join(covered, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * c")
    cuts = free.select("lang", "phrase", F.col("c").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select(
        "lang", "phrase", "a", "at", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("at") + 1, F.size("w")), " ").alias("right"))
    part = again().where("k >= 1")
    sizes = again().where("k = 0").select("lang", F.col("c").alias("n"))
    valued = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"]).join(
        part.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"]).join(sizes, "lang")
    score = F.expr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x")
    scored = valued.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest).select(
        "lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    # a language may hold most phrases: the best of every group, then the best of these
    order = "order by score desc, a desc, phrase"
    grouped = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(settings.groups)))
    near = grouped.withColumn("place", F.expr(f"row_number() over (partition by lang, group {order})")).where(F.col("place") <= settings.top)
    return near.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})").cast("long")).where(F.col("rank") <= settings.top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
