import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from steadymap.llm import byte_bpe, chunk_bpe, library_slices, pieces, rans
from steadymap.llm.queries import BYTES, WORDS, vocabulary


def texts():
    rng = random.Random(0)
    bits = ["the ", "don't ", " ", "  ", "\n", "\t", " \n", "\x0b", "\x1c", "\x85", "\xa0", "　", "Éa", "é", "ﬁ", "ΣΑΣ", "İ", "12 3", "...", "!?", "𝄞", "<|endoftext|>",
            "<|startoftext|> ", "word", "Word", "日本", "‍", "\x00", "'s", " 's", "###", "aé, ", "b.", "c,. "]
    out = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(1500)]
    passage = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(600))
    return out + ["", " ", "   ", "a   ", "   a", passage, "x " + passage, passage + " y", passage * 20, "word " * 40_000, "é" * 30_000]


@pytest.mark.parametrize("store, batch", [(600_000, 3_000_000), (40, 100)])
def test_slices_equal_the_library(store, batch):
    settings = byte_bpe.Settings(store=store, batch=batch, part=1000)
    library, coder = Tokenizer.from_file(vocabulary(BYTES)), library_slices.LibraryCoder(vocabulary(BYTES), byte_bpe.classes(), settings)
    some = texts()[: 1505 if store == 40 else None]
    for t, ids in zip(some, coder.ids(some)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_slices_equal_the_library_in_all_of_unicode():
    library, coder = Tokenizer.from_file(vocabulary(BYTES)), library_slices.LibraryCoder(vocabulary(BYTES), byte_bpe.classes())
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    some = [f"a{''.join(f'{c} {c}1' for c in points[k : k + 2000])}" for k in range(0, len(points), 2000)]
    for t, ids in zip(some, coder.ids(some)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_slices_of_other_white_space():
    library, coder = Tokenizer.from_file(vocabulary(BYTES)), library_slices.LibraryCoder(vocabulary(BYTES), byte_bpe.classes())
    odd = ["\xa0", "\x85", "\u2003", "\u3000", "\u2028", "\u1680", "\u200b", "\x1c"]
    some = [f"x {a} y {a}{b} z {b} {a} w{a}  {b}" for a in odd for b in odd]
    for t, ids in zip(some, coder.ids(some)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_encoders_equal_the_library(monkeypatch):
    name, kind = WORDS, pieces.WordEncoder
    library, coder = Tokenizer.from_file(vocabulary(name)), kind(vocabulary(name))
    for limit in (pieces.CACHE, 40):
        monkeypatch.setattr(pieces, "CACHE", limit)
        for t in texts()[: 1505 if limit == 40 else None]:
            assert np.frombuffer(coder.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_chunks_equal_the_library_and_are_reused():
    library, coder = Tokenizer.from_file(vocabulary(WORDS)), chunk_bpe.ChunkEncoder(vocabulary(WORDS), chunk_bpe.Settings(bits=4, store=500, joins=300))
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), "<u2").tolist() == ids, repr(t[:80])
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert coder.reused > 400 and coder.encoded > 20


def test_a_join_that_disagrees_is_encoded_again(monkeypatch):
    coder = chunk_bpe.ChunkEncoder(vocabulary(WORDS), chunk_bpe.Settings(bits=1))
    text = " ".join(f"w{k} x{k} some words" for k in range(40))
    want = coder.words.whole(text)
    monkeypatch.setattr(coder, "joins", lambda a, b: False)
    assert coder.encode(text) == want and coder.repaired > 5


def test_digests(spark):
    rows = [(n, t, "q") for n, t in enumerate(texts()[-400:])] + [(7, None, "q"), (None, "a b", "q"), (None, "a b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    library = Tokenizer.from_file(vocabulary(WORDS))
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, chunk_bpe.digests(docs, vocabulary(WORDS)).collect()), key=str) == sorted(want, key=str)
    assert chunk_bpe.encode(docs.where("doc_id = 7"), vocabulary(WORDS)).count() == 2
    assert chunk_bpe.digests(docs.limit(0), vocabulary(WORDS)).collect() == []


@pytest.mark.parametrize("n, lanes, stride", [(1, 8, 2), (7, 8, 2), (8, 8, 1), (1000, 8, 5), (100_000, 512, 16)])
def test_blocks_round_trip(n, lanes, stride):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.geometric(0.01, n), 50_000), np.zeros(n, int), rng.integers(0, 50_257, n)):
        ids = ids.astype(np.uint16)
        table = rans.Table.of(np.bincount(ids, minlength=1 << 16))
        assert int(table.freq.sum()) == 1 << rans.BITS
        back = rans.Table.load(table.dump())
        assert (back.freq == table.freq).all()
        raw, slots = rans.encode(ids, table, lanes, stride), table.slots()
        assert (rans.decode(raw, back, slots) == ids).all()
        for first in range(0, -(-(-(-n // lanes)) // stride), 3):
            want = ids[first * stride * lanes : (first + 2) * stride * lanes]
            assert (rans.decode(raw, back, slots, first, first + 2) == want).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16) % 300
    table = rans.Table.of(np.bincount(ids, minlength=1 << 16))
    raw = bytearray(rans.encode(ids, table, 64, 8))
    raw[-30] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(raw), table, table.slots())


def test_files(spark):
    rows = [(n * 7 % 1511 - 40, t, 5) for n, t in enumerate(texts()[-700:])] + [(3, "same", 5), (3, "id", 5), (9_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    library, start, want = Tokenizer.from_file(vocabulary(BYTES)), 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    settings = rans.Settings(block=300, lanes=16, stride=2, segment=1000, file_bytes=60_000)
    assert sorted(map(tuple, rans.round_trip(docs, vocabulary(BYTES), settings).collect())) == sorted(want)
    assert rans.round_trip(docs.limit(0), vocabulary(BYTES)).collect() == []
