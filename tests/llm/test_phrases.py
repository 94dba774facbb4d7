"""Dynamic itemset counting against plain counts of all runs of words."""

import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from steadymap.llm import phrases
from steadymap.llm.common import Stage

SCHEMA = "doc_id long, text string, lang string, rank int"


def plain(rows, least, top, longest=5):
    runs, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                runs.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: c for p, c in runs.items() if c >= least}
    out = []
    for (lang, w), a in found.items():
        inside = any(len(v) > len(w) and lg == lang and 100 * c >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
                     for (lg, v), c in found.items())
        if len(w) < 2 or inside:
            continue
        score, k = min((1000 * a * n[lang] // (found[lang, w[:k]] * found[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, found[lang, w[:k]], found[lang, w[k:]], n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(lang, k, *r[1:]) for k, r in enumerate(best, 1)]
    return found, sorted(result)


def fixture(seed):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "a", "éa", "x-y", "new\x85", "york", "city", "to", "be", "or", "not", "\x00", "日本"]
    rows = []
    for d in range(160):
        p = 1 / np.arange(1, len(words) + 1)
        picked = rng.choice(words, rng.integers(0, 60), p=p / p.sum())
        text = "".join(w + rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\x0b"], p=[0.7, 0.05, 0.05, 0.06, 0.06, 0.04, 0.04]) for w in picked)
        rows.append((d, text, ["en", "de", None, "", "und"][rng.integers(5)], 1))
    rows += [(500, "to be or not to be " * 40, "en", 1), (501, None, "en", 1), (502, "", None, 1), (None, "new york city", "de", 1), (503, "rare only here", "fr", 1)]
    return rows + [(k, "one two three four five six", "en", 1) for k in range(600, 630)] + rows[:20]


@pytest.mark.parametrize("settings", [
    phrases.Settings(least=10, top=2000, bits=16), phrases.Settings(least=6, top=7, shards=5, bits=16, block=300, groups=3),
    phrases.Settings(least=10, top=50, shards=2, bits=4)])
def test_against_plain_counts(spark, settings):
    """Also with a table so small that everything shares its places."""
    rows = fixture(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found, want = plain(rows, settings.least, settings.top)
    counted = phrases.frequent(docs, Stage(spark, "test"), settings).where("k > 0").collect()
    assert {(r.lang, tuple(r.phrase.split(" "))): r.c for r in counted} == found
    assert sorted(map(tuple, phrases.collocations(docs, settings).collect())) == want
    assert max(len(p) for _, p in found) == 5


def test_places_marked_before_the_parts(spark):
    """Places shared with phrases of earlier scans do not cut the circle of a longer phrase."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    sentences = [" ".join(rng.choice(words, 8)) for _ in range(60)]
    rows = [(d, " ".join(rng.choice(sentences) if rng.random() < 0.6 else " ".join(rng.choice(words, 5, p=p / p.sum())) for _ in range(6)), "en", 1) for d in range(300)]
    settings = phrases.Settings(least=10, bits=10)
    counted = phrases.frequent(spark.createDataFrame(rows, SCHEMA).repartition(2), Stage(spark, "test"), settings).where("k > 0").collect()
    assert {(r.lang, tuple(r.phrase.split(" "))): r.c for r in counted} == plain(rows, settings.least, settings.top)[0]


def test_products_beyond_64_bits(spark, monkeypatch):
    """1000 a n passes 2^63; the score stays exact."""
    a, n = 3_000_000_000, 40_000_000_000
    table = [("en", 0, "", n), ("en", 1, "x", a + 7), ("en", 1, "y", a + 1), ("en", 2, "x y", a)]
    monkeypatch.setattr(phrases, "frequent", lambda docs, stage, settings: stage.save(
        spark.createDataFrame(table, "lang string, k int, phrase string, c long"), "frequent"))
    got = phrases.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, a + 7, a + 1, n, 1000 * a * n // ((a + 7) * (a + 1)))]


def test_long_texts_are_cut_at_ends_of_pieces():
    text = b"aa bb. cc dd, " * 1000 + b"x " * 500
    assert b"".join(phrases.cut(text, 100)) == text and all(p[:1] in (b".", b",") for p in phrases.cut(text, 100)[1:])


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_of_phrases_are_numbered_without_a_search(monkeypatch):
    """Words of a phrase become numbers by hashing; a search in all keys took over half the time of a scan."""
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, *more, **names: searched.append(len(a)) or search(a, *more, **names))
    text = ". ".join(f"a{k % 7} b{k % 11} c{k % 13} d{k % 3} e" for k in range(400)).encode()
    counter = phrases.Counter(np.zeros(1 << 8, np.uint8), 1, phrases.Settings(bits=8))
    rows = [r for b in counter.count(["en"], [text]) for r in b.to_pylist() if r["k"] == 5]
    assert sum(r["c"] for r in rows) == 400 and len(rows) == 400 and max(searched) == 1


def test_files_of_finished_scans_go(spark, monkeypatch):
    """Once the counts of a scan are written, the files of its shuffle are removed, not left to the driver's collector."""
    left, save = [], Stage.save

    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in folders for p in Path(d.getPath()).glob("*/shuffle_*.data")}

    def watched(stage, df, name):
        before = files()
        out = save(stage, df, name)
        if name.startswith("counts-"):
            until = time.time() + 10  # files are removed in the background
            while (stay := files() - before) and time.time() < until:
                time.sleep(0.05)
            left.append(len(stay))
        return out

    monkeypatch.setattr(Stage, "save", watched)
    docs = spark.createDataFrame(fixture(3), SCHEMA).repartition(4)
    phrases.frequent(docs, Stage(spark, "test"), phrases.Settings(least=10, bits=16))
    assert len(left) > 2 and not any(left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_counted_rows_come_in_bounded_batches(monkeypatch):
    """A task holds a few thousand rows beside its numbers, not all phrases of a block as text at once."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 400)).encode() + b". " + b"a,b" for _ in range(20)]
    languages = [["en", "de"][k % 2] for k in range(20)]
    counter = lambda: phrases.Counter(np.zeros(1 << 8, np.uint8), 1, phrases.Settings(bits=8))
    whole = [r for b in counter().count(languages, texts) for r in b.to_pylist()]
    monkeypatch.setattr(phrases, "ROWS", 1000)
    batches = list(counter().count(languages, texts))
    assert [r for b in batches for r in b.to_pylist()] == whole and len(whole) > 9000
    assert max(b.num_rows for b in batches if b["k"][0].as_py() > 1) == 1000
