"""Repair of conversations by cheapest edits, with Four-Russians block tables.

A row of a conversation is one of nine symbols (its role's initial, or that it has to go; whole or truncated).
What the rest of a conversation costs from each of four grammar states is a vector; less its minimum, only a few
dozen vectors exist. For every vector and every block of four symbols a table holds the vector in front of the
block and the cost added, so a conversation is solved from its end by one look-up a block. Tracing goes forward:
a block is expanded backward into the vectors between its rows, and of the edits that keep the cost the first in
ASCII is taken, which makes the first of all cheapest sequences. Expanded blocks are kept.

Long conversations are cut into chunks. A chunk is itself a function of the vector behind it, so chunks are
summarised apart, chained, and then traced apart: no task holds more than a chunk of symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage

#: Fixed values of the contract: white space, sentence ends, costs.
WHITE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Symbols: initials s, u, a, any other; four more if truncated; a row that has to go; no row at all.
INITIALS, OTHER, CUT, GONE, NOTHING, SYMBOLS = "sua", 3, 4, 8, 9, 10
#: Grammar states: nothing written, behind s, behind u, behind a. Where an initial leads, and what may be inserted.
STEPS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
GIVES = (2, 2, 3, 2)  # the state behind an inserted or reroled row
END = (0, 10, 5, 0)  # what is still to be inserted at the end
LENGTH = 4


@dataclass(frozen=True)
class Settings:
    """Rows of a conversation that are summarised and traced as one."""

    chunk: int = 65_536


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage; null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return plain.where("how <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                          F.when(F.col("how") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their text: a digest in its place, the role's initial, blank and truncated."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "copies", code.alias("initial"),
                       (bare == "").alias("blank"), ((bare != "") & ~F.right(bare, F.lit(1)).isin(list(ENDS))).alias("truncated"))


def marked(damaged: DataFrame, stage: Stage) -> DataFrame:
    """One row per different (conv_id, turn, role, text): how often it stands there, and whether it was seen earlier."""
    alike = stage.save(_faults(damaged).groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("initial", "blank", "truncated")]), "alike")
    # only texts that stand at several turns have to be looked up again
    first = alike.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n"))
    found = stage.again("alike", alike).alias("r").join(
        first.where("n > 1").alias("f"), F.expr("r.conv_id <=> f.conv_id and r.role = f.role and r.digest = f.digest"), "left")
    return stage.save(found.select("r.*", (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("r.turn"))).alias("seen")), "marked")


def counts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated."""
    again = F.col("copies") - F.when(F.col("seen"), 0).otherwise(1)
    per_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(again)).alias("duplicate"),
        F.sum((F.col("truncated") & ~F.col("seen")).cast("long")).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return per_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


class Tables:
    """Normalised vectors and their transitions over single symbols and blocks of ``LENGTH`` symbols."""

    def __init__(self):
        self.vectors, self.names, steps = [END], {END: 0}, []
        for vector in self.vectors:  # grows until no symbol gives a new one
            row = []
            for symbol in range(SYMBOLS):
                before, low = self._before(vector, symbol)
                if before not in self.names:
                    self.names[before] = len(self.vectors)
                    self.vectors.append(before)
                row.append((self.names[before], low))
            steps.append(row)
        one = np.array(steps)  # vector, symbol -> vector in front, cost added
        self.one = one[:, :, 0].tolist()
        n = len(self.vectors)
        blocks = np.array(list(product(range(SYMBOLS), repeat=LENGTH)))
        vector, cost = np.repeat(np.arange(n)[:, None], len(blocks), 1), np.zeros((n, len(blocks)), np.int64)
        for k in reversed(range(LENGTH)):
            got = one[vector, blocks[:, k]]
            vector, cost = got[:, :, 0], cost + got[:, :, 1]
        self.front, self.added = vector.astype(np.int16), cost
        self.expanded: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    @staticmethod
    def _before(after: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        if symbol == NOTHING:
            return after, 0
        cost = [min(c for c, _, _ in _edits(s, symbol, after)) for s in range(4)]
        for _ in range(4):
            cost = [min(c, INSERT + cost[GIVES[s]]) for s, c in enumerate(cost)]
        return tuple(c - min(cost) for c in cost), min(cost)

    def trace(self, after: int, symbol: int, state: int) -> tuple[str, int, int]:
        """Edits in front of and at a row, the state behind it, their cost; ``after`` names the vector behind the row."""
        if symbol == NOTHING:
            return "", state, 0
        behind = self.vectors[after]
        here = [min(c for c, _, _ in _edits(s, symbol, behind)) for s in range(4)]
        for _ in range(4):
            here = [min(c, INSERT + here[GIVES[s]]) for s, c in enumerate(here)]
        letters, spent = "", 0
        while True:
            best = min(((letter, to, c - behind[to]) for c, letter, to in _edits(state, symbol, behind) if c == here[state]), default=None)
            # I stands behind D and before K and R
            if (best is None or best[0] > "I") and INSERT + here[GIVES[state]] == here[state]:
                letters, spent, state = letters + "I", spent + INSERT, GIVES[state]
            else:
                return letters + best[0], best[1], spent + best[2]

    def expand(self, after: int, block: int, state: int) -> tuple[str, int, int]:
        """The same for a whole block, whose inner vectors are worked out backward from ``after``."""
        key = (after, block, state)
        if key not in self.expanded:
            symbols = [block // SYMBOLS**k % SYMBOLS for k in reversed(range(LENGTH))]
            behind = [after]
            for x in reversed(symbols[1:]):
                behind.append(self.one[behind[-1]][x])
            letters, spent = "", 0
            for x, v in zip(symbols, reversed(behind)):
                more, state, cost = self.trace(v, x, state)
                letters, spent = letters + more, spent + cost
            self.expanded[key] = letters, state, spent
        return self.expanded[key]


def _edits(state: int, symbol: int, after: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """Cost with the rest, initial and next state of every edit of a row but inserting."""
    out = [(DELETE + after[state], "D", state)]
    if symbol != GONE:
        cut = TRUNCATED if symbol >= CUT else 0
        if (to := STEPS.get((state, symbol % CUT))) is not None:
            out.append((KEEP + cut + after[to], "K", to))
        out.append((REROLE + cut + after[GIVES[state]], "R", GIVES[state]))
    return out


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks_of(codes: bytes) -> list[int]:
    """Symbols as numbers of blocks; the last block is filled with rows that are none."""
    x = np.frombuffer(codes + bytes([NOTHING]) * (-len(codes) % LENGTH), np.uint8).reshape(-1, LENGTH).astype(np.int64)
    return (x @ (SYMBOLS ** np.arange(LENGTH)[::-1])).tolist()


def trace(codes: bytes, after: int = 0, state: int = 0) -> tuple[str, int, int]:
    """Edits, last state and cost of a chunk between a state and the name of the vector behind it (0: the end)."""
    t, blocks = tables(), blocks_of(codes)
    behind, front = [after], t.front
    for block in reversed(blocks[1:]):
        behind.append(int(front[behind[-1], block]))
    letters, spent = [], 0
    for block, vector in zip(blocks, reversed(behind)):
        more, state, cost = t.expand(vector, block, state)
        letters.append(more)
        spent += cost
    return "".join(letters), state, spent


def finish(state: int) -> str:
    """What is inserted behind the last row."""
    return "I" * (END[state] // INSERT)


def summary(codes: bytes) -> tuple[list[int], list[int]]:
    """A chunk as a function: the vector in front for every vector behind, and the last state for every vector and first state."""
    t, blocks = tables(), blocks_of(codes)
    behind = [np.arange(len(t.vectors))]
    for block in reversed(blocks):
        behind.append(t.front[behind[-1], block].astype(np.int64))
    state = np.tile(np.arange(4), (len(t.vectors), 1))
    for block, vectors in zip(blocks, reversed(behind[:-1])):
        state = np.array([[t.expand(int(v), block, int(s))[1] for s in row] for v, row in zip(vectors, state)])
    return behind[-1].tolist(), state.ravel().tolist()


CHUNK = "part int, seq long, codes binary, first int, last int, illegal long"


def chunks(rows: DataFrame, settings: Settings) -> DataFrame:
    """conv_id and the chunks of its symbols in order of (part, seq), with their first and last initials and illegal neighbours inside."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    gone = F.when(F.col("blank") | F.col("seen"), GONE).otherwise(F.col("initial") + F.when(F.col("truncated"), CUT).otherwise(0))
    # neighbouring ranges: a conversation of any length lies in as many partitions as it fills
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), gone.cast("int").alias("code"), F.col("initial").cast("int").alias("initial"), "copies")
    legal, size = {(0, 1), (1, 2), (2, 1)}, settings.chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, codes, first, last, illegal, seq = [], None, bytearray(), 0, 0, 0, 0
        part, kind = 0, None

        def close():
            nonlocal codes, illegal, seq
            if codes:
                out.append((conv, part, seq, bytes(codes), first, last, illegal))
            codes, illegal, seq = bytearray(), 0, seq + 1

        def emit():
            columns = list(zip(*out)) if out else [[]] * 7
            types = [kind, pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            names = ["conv_id", "part", "seq", "codes", "first", "last", "illegal"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.column(0).type
            for c, p, code, initial, n in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    close()
                    conv, seq = c, 0
                part = p
                for k in range(n):  # what stands there again was seen
                    if not codes:
                        first = initial
                    else:
                        illegal += (last, initial) not in legal
                    codes.append(GONE if k else code)
                    last = initial
                    if len(codes) == size:
                        close()
            if len(out) >= 10_000:
                yield emit()
        close()
        if out:
            yield emit()

    return sorted_.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {CHUNK}")


def chained(cut: DataFrame, stage: Stage) -> DataFrame:
    """conv_id, part, seq, after, state of the chunks of conversations that have several: where their traces begin."""
    several = cut.groupBy("conv_id").count().where("count > 1")
    many = stage.again("chunks", cut).alias("c").join(several.alias("s"), F.expr("c.conv_id <=> s.conv_id"), "left_semi")
    kind = cut.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [summary(c.as_py()) for c in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([f for f, _ in got], pa.list_(pa.int32())),
                                              pa.array([s for _, s in got], pa.list_(pa.int32()))], names=["conv_id", "part", "seq", "front", "behind"])

    summed = many.select("conv_id", "part", "seq", "codes").mapInArrow(
        run, f"conv_id {kind}, part int, seq long, front array<int>, behind array<int>")
    # one small row a chunk; a chunk has up to ``Settings.chunk`` rows
    row = F.struct("part", "seq", "front", "behind")
    lists = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("chunks"))
    one = lambda after, place: F.struct(after.alias("after"), place["part"].alias("part"), place["seq"].alias("seq"), place["behind"].alias("behind"))
    none = F.array().cast("array<struct<after:int, part:int, seq:bigint, behind:array<int>>>")
    backward = F.aggregate(F.reverse("chunks"), F.struct(F.lit(0).alias("v"), none.alias("done")), lambda s, x: F.struct(
        F.get(x["front"], s["v"]).alias("v"), F.concat(s["done"], F.array(one(s["v"], x))).alias("done")), lambda s: F.reverse(s["done"]))
    none = F.array().cast("array<struct<part:int, seq:bigint, after:int, state:int>>")
    place = lambda s, x: F.struct(x["part"].alias("part"), x["seq"].alias("seq"), x["after"].alias("after"), s["s"].alias("state"))
    forward = F.aggregate(F.col("back"), F.struct(F.lit(0).alias("s"), none.alias("done")), lambda s, x: F.struct(
        F.get(x["behind"], x["after"] * 4 + s["s"]).alias("s"), F.concat(s["done"], F.array(place(s, x))).alias("done")), lambda s: s["done"])
    return lists.select("conv_id", backward.alias("back")).select("conv_id", F.explode(forward).alias("c")).select("conv_id", "c.*")


def solved(cut: DataFrame, stage: Stage) -> DataFrame:
    """conv_id, illegal, cost, audit of every conversation that has rows."""
    starts = stage.save(chained(cut, stage), "starts")
    placed = stage.again("chunks", cut).alias("c").join(starts.alias("s"), F.expr("c.conv_id <=> s.conv_id and c.part = s.part and c.seq = s.seq"), "left").select(
        "c.conv_id", "c.part", "c.seq", "codes", "first", "last", "illegal", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("state", F.lit(0)).alias("state"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [trace(c, v, s) for c, v, s in zip(*(batch.column(k).to_pylist() for k in (3, 7, 8)))]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4, 5, 6)), *new], names=[
                "conv_id", "part", "seq", "first", "last", "illegal", "edits", "state", "cost"])

    kind = cut.schema["conv_id"].dataType.simpleString()
    traced = placed.mapInArrow(run, f"conv_id {kind}, part int, seq long, first int, last int, illegal long, edits string, state int, cost long")
    pieces = traced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "first", "last", "illegal", "edits", "state", "cost"))).alias("p"))
    end = F.element_at("p", -1)["state"]
    rest = F.element_at(F.array(*[F.lit(finish(s)) for s in range(4)]), end + 1)
    legal = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    seams = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.size("p")), lambda a, b: F.when(legal(a["last"], b["first"]), 0).otherwise(1))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    return pieces.select("conv_id", (total(F.transform("p", lambda x: x["illegal"])) + total(seams)).alias("illegal"),
                         (total(F.transform("p", lambda x: x["cost"])) + INSERT * F.length(rest)).alias("cost"),
                         F.concat(F.array_join(F.transform("p", lambda x: x["edits"]), ""), rest).alias("audit"))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def written(damaged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` with repaired_sha256. A SHA-256 is sequential, so a conversation's texts pass through one task, row by row."""
    kind = verdicts.schema["conv_id"].dataType.simpleString()
    rows = damaged.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text",
                          "copies", *[F.lit(None).cast("long").alias(c) for c in NAMES])
    heads = verdicts.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"),
                            F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), *NAMES)
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sent = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "copies", *NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, at, digest, written_rows, after = None, "", 0, hashlib.sha256(), 0, ""
        out, type_ = [], None

        def put(role: str, text: str):
            nonlocal written_rows
            digest.update((("\n" if written_rows else "") + role + ":" + text).encode())
            written_rows += 1

        def given() -> str:
            return "assistant" if after == "u" else "user"

        def inserts():
            nonlocal at, after
            while at < len(audit) and audit[at] == "I":
                role = given()
                put(role, "")
                after, at = role[0], at + 1

        def close():
            if head is not None:
                inserts()
                out.append((*head, audit, digest.hexdigest()))

        def emit():
            types = [type_, *[pa.int64()] * len(NAMES), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", *NAMES, "audit", "repaired_sha256"])
            out.clear()
            return batch

        for batch in batches:
            type_ = batch.column(0).type
            for conv, row_kind, role, text, copies, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if row_kind == 0:
                    close()
                    head, audit, at, digest, written_rows, after = (conv, *values), text, 0, hashlib.sha256(), 0, ""
                    continue
                for _ in range(copies):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        new = role if edit == "K" else given()
                        put(new, text)
                        after = new[0]
            if len(out) >= 5_000:
                yield emit()
        close()
        if out:
            yield emit()

    return sent.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in NAMES)}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after the damage.

    Null roles and texts are one space, null turns come first, a null conv_id is a conversation of its own. Rows of one
    turn are ordered by role and digest of the text; repeated rows are duplicates. A conversation that lost all rows has
    zeros, an empty audit and the hash of the empty string. Texts and conversations may have any length; an empty
    table gives no rows; other columns are ignored.
    """
    stage = Stage(conversations.sparkSession, "repair")
    damaged = damage(conversations)
    rows = marked(damaged, stage)
    cut = stage.save(chunks(rows, settings), "chunks")
    every = conversations.select("conv_id").distinct().alias("e")
    verdicts = every.join(counts(stage.again("marked", rows)).alias("c"), F.expr("e.conv_id <=> c.conv_id"), "left").join(
        solved(cut, stage).alias("s"), F.expr("e.conv_id <=> s.conv_id"), "left").select(
        "e.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NAMES], F.coalesce("audit", F.lit("")).alias("audit"))
    return written(damaged, stage.save(verdicts, "verdicts"))
