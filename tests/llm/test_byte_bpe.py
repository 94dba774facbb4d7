"""Byte-level BPE against the tiktoken library, whole texts and single slices."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from steadymap.llm import byte_bpe
from steadymap.llm.queries import RANKS, vocabulary

SMALL = byte_bpe.Settings(batch=60, part=9, wide=4, store=30)


@pytest.fixture(scope="module")
def library():
    with open(vocabulary(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def table():
    return byte_bpe.classes()


def texts():
    rng = random.Random(0)
    bits = ["the", "don't", " ", "  ", "\n", "\t", " \n", "'s", "'S", "'re", "'ve", "''", "'ll", "'l", "'d", "'m", "'t't", "é", "日本", "١٢", "12", "Ⅷ", "²", "...", "!?", "　",
            "\xa0", "\x85", "\x1c", "\x00", "\U0001d11e", "ﬁ", "á", "_", "'", "​", "\r\n", "x'ss", '"s', "<|endoftext|>"]
    out = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    return out + ["", "a" * 5000, "=" * 7000, "é" * 3000, " " * 1000 + "x", "\n" * 999, "ab " * 40_000, "zqxj" * 2000 + " " + "word" * 30]


@pytest.mark.parametrize("settings", [byte_bpe.Settings(), SMALL])
def test_ids_equal_the_library(library, table, settings):
    coder, some = byte_bpe.Coder(vocabulary(RANKS), table, settings), texts()
    some = some[:1500] if settings == SMALL else some
    got = {}
    for place, coded in coder.encode(some):
        got[place] = [k for ids, _ in coded for k in ids.tolist()]
    assert list(got) == list(range(len(some)))
    for place, text in enumerate(some):
        assert got[place] == library.encode_ordinary(text), repr(text[:80])


def test_every_code_point_next_to_others(library, table):
    """Classes and boundaries hold for all of Unicode, not only for what the fixtures contain."""
    coder = byte_bpe.Coder(vocabulary(RANKS), table)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200))]
    some = [f"a{''.join(f'{c} {c}1{c}' for c in points[k : k + 500])}" for k in range(0, len(points), 500)]
    for place, coded in coder.encode(some):
        assert [k for ids, _ in coded for k in ids.tolist()] == library.encode_ordinary(some[place])


def test_scan_equals_one_state_after_the_other(table):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 31, 1000, 4097):
        points = rng.choice([ord(c) for c in "astrevlmd''  \n1!é　"], n).astype(np.uint32)
        first = rng.random(n) < 0.1
        first[0] = True
        got, pattern = byte_bpe.begins(points, first, table), __import__("regex").compile(public_tokenizers.PATTERN)
        cut = [*np.flatnonzero(first).tolist(), n]
        want = [a + m.start() for a, b in zip(cut, cut[1:]) for m in pattern.finditer("".join(map(chr, points[a:b].tolist())))]
        assert np.flatnonzero(got).tolist() == want


def test_merging_in_rounds_equals_the_heap(table):
    rng = random.Random(3)
    merger = byte_bpe.Merger(vocabulary(RANKS))
    some = {bytes(rng.choices(b"abcent e\xc3\xa9", k=rng.randint(2, 20))) for _ in range(3000)} - set(merger.ranks)
    got = merger.merge(sorted(some))
    assert got == [merger.alone(p) for p in sorted(some)]


def test_query_and_slices(spark, library):
    rows = [(n, t, "q") for n, t in enumerate(texts()[-300:])] + [(7, None, "q"), (None, "a b", "q"), (None, "a b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.digests(docs, vocabulary(RANKS), byte_bpe.Settings(part=500)).collect()), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode(docs, vocabulary(RANKS), byte_bpe.Settings(part=500))
    assert sorted((r.doc_id, bytes(r.raw)) for r in byte_bpe.decode(encoded.where("doc_id is not null"), vocabulary(RANKS)).collect()) == sorted(
        (d, (t or "").encode()) for d, t, _ in rows if d is not None)
    merger, pattern = byte_bpe.Merger(vocabulary(RANKS)), __import__("regex").compile(public_tokenizers.PATTERN)
    of = dict((d, t) for d, t, _ in rows if d != 7)
    for r in encoded.where("doc_id is not null and doc_id <> 7").collect():
        ends = [*r.slices[1:], len(r.ids)]
        if len(ends) < 50:  # any slice decodes by itself
            got = [merger.decode(np.array(r.ids[a:b], np.int64)).tobytes().decode() for a, b in zip(r.slices, ends)]
            assert got == pattern.findall(of[r.doc_id])
    assert byte_bpe.digests(docs.limit(0), vocabulary(RANKS)).collect() == []
