import zlib

import numpy as np

from steadymap.llm import langid
from steadymap.llm.queries import op2_language


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_language(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in held]) < 0.1


def test_odd_texts_and_rejection(spark):
    texts = [("the cat and the dog were here", "en"), ("le chat et le chien sont ici", "fr")] * 40
    docs = spark.createDataFrame([(n, t, x, "q") for n, (t, x) in enumerate(texts)] + [(900, None, "en", "q"), (901, "", None, "q"), (902, "12 -- 3!", "fr", "q"),
                                 (903, "the dog " * 50_000, None, "q"), (None, "le chien", "xx", "q"), (900, None, "en", "q"), (904, "ÇA", None, "q")],
                                 "doc_id long, text string, lang string, score string")
    small = langid.Settings(buckets=1 << 12)
    model = langid.fit(docs, small)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.identify(docs, model, small).collect()}
    assert [(got[n].lang_pred, got[n].score) for n in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en" and got[None].lang_pred == "fr" and got[None].held_out
    assert got[904].lang_pred in ("en", "fr")
    assert got[0].lang_pred == "en" and got[1].lang_pred == "fr"


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def test_more_languages_than_are_broadcast(spark):
    docs = spark.createDataFrame([(n, f"text of language {chr(97 + n % 26)}", f"l{n:02}") for n in range(40) if zlib.crc32(str(n).encode()) % 5],
                                 "doc_id long, text string, lang string")
    few = langid.Settings(sample_all=20, buckets=1 << 10, epochs=1)
    assert langid.fit(docs, few).langs == sorted(r.lang for r in docs.collect())
