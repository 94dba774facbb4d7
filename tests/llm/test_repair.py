"""Conversation repair against a plain dynamic program over whole strings of edits."""

import hashlib
import random
import re
import zlib

import pytest

from steadymap.llm import repair


def plain_audit(symbols):
    """(cost, edits) of the cheapest, first in ASCII: a table of states with the best edits so far."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    new_role = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, edits) in list(best.items()):
                best[new_role[state]] = min(best.get(new_role[state], (1 << 40, "")), (cost + 5, edits + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, gone, cut in symbols:
        after = {}
        for state, (cost, edits) in best.items():
            ways = [(cost + 2, edits + "D", state)]
            if not gone:
                ways.append((cost + 1 + 5 * cut, edits + "R", new_role[state]))
                if (state, initial) in step:
                    ways.append((cost + 5 * cut, edits + "K", step[state, initial]))
            for c, e, to in ways:
                after[to] = min(after.get(to, (1 << 40, "")), (c, e))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    """conv_id -> result of the contract, for (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            by[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, got in by.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, symbols, n = set(), [], [0, 0, 0, 0]
        for k, (_, role, text) in enumerate(got):
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                n[fault] += 1
            n[3] += bool(k) and (got[k - 1][1][:1] + role[:1]) not in ("su", "ua", "au")
            symbols.append((role[:1], fault in (0, 1), fault == 2))
            seen.add((role, text))
        cost, audit = plain_audit(symbols)
        written, left = [], list(got)
        for e in audit:
            row = left.pop(0) if e != "I" else (None, "", "")
            if e != "D":
                given = "assistant" if written and written[-1][0][0] == "u" else "user"
                written.append((row[1] if e == "K" else given, row[2]))
        turns = {t for t, _, _ in got if t is not None}
        text = "\n".join(f"{r}:{t}" for r, t in written)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def fixture(seed, convs, rows):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "unknown", "tool", "", "s", None]
    texts = ["Yes.", "no", "Why?  ", " \t\n", "", "x!", "é…", "a.b", None, "same text", "\xa0"]
    out = [(rng.choice([*range(convs), None]), rng.choice([None, *range(-3, rows // convs + 4)]), rng.choice(roles),
            rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}{rng.choice('.?, ')}") for _ in range(rows)]
    return out + out[: rows // 10] + [(10**6 + k, 0, "user", "gone?") for k in range(40)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, convs, rows, chunk", [(1, 150, 1200, 65_536), (2, 2, 900, 5), (3, 1, 2500, 64)])
def test_against_the_plain_version(spark, seed, convs, rows, chunk):
    some = fixture(seed, convs, rows)
    docs = spark.createDataFrame([(*r, "clash") for r in some], SCHEMA + ", digest string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(docs, repair.Settings(chunk=chunk)).collect()}
    want = plain(some)
    assert set(got) == set(want)
    for conv, result in want.items():
        assert got[conv] == result, conv


def test_every_short_sequence():
    from itertools import product

    names = [("s", False, False), ("u", False, False), ("a", False, False), ("x", False, False), ("s", False, True), ("u", False, True),
             ("a", False, True), ("x", False, True), ("u", True, False)]
    for n in (1, 2, 3, 4, 5):
        for codes in product(range(9), repeat=n) if n < 5 else random.Random(5).sample(list(product(range(9), repeat=5)), 4000):
            edits, state, cost = repair.trace(bytes(codes))
            end = repair.finish(state)
            assert (cost + 5 * len(end), edits + end) == plain_audit([names[c] for c in codes])


def test_chunks_chain_to_the_whole():
    rng = random.Random(6)
    for _ in range(50):
        codes = bytes(rng.randrange(9) for _ in range(rng.randint(1, 300)))
        cut = [codes[k : k + 37] for k in range(0, len(codes), 37)]
        sums, after = [repair.summary(c) for c in cut], [0]
        for front, _ in reversed(sums[1:]):
            after.insert(0, front[after[0]])
        state, edits = 0, ""
        for c, v, (_, behind) in zip(cut, after, sums):
            more, to, _ = repair.trace(c, v, state)
            assert to == behind[4 * v + state]
            state, edits = to, edits + more
        assert edits == repair.trace(codes)[0]


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
