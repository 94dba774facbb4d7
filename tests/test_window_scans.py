"""The quality row of a topic model counts windows once per window size."""

from steadymap.operators import topics


def test_one_scan_per_window_size(spark, monkeypatch):
    sizes, count = [], topics.window_counts
    monkeypatch.setattr(topics, "window_counts", lambda lists, words, size: sizes.append(size) or count(lists, words, size))
    lists = spark.createDataFrame([(n, ["a", "b", "c"][n % 2 :] * 3) for n in range(6)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "topic int, word string, rank int")
    row = topics.evaluate(lists, words, "x", 1).first()
    alone = [of(lists, words).first()["coherence"] for of in (topics.coherence_uci, topics.coherence_npmi)]
    assert [row["coherence_c_uci"], row["coherence_c_npmi"]] == alone and sizes[:-2] == [10, None, 110]
