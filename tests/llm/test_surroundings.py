"""Passages at the edge of the least length, whose neighbours repeat as well."""

import random

import numpy as np

from pagewright.llm import substring_dedup


def copied(seed=31, n=24, size=(51, 76)):
    """Each passage stands in documents p and 100 + p; 200 + p and 300 + p are their exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    passages, rows = [], []
    for p in range(n):
        passages.append([word() for _ in range(rng.randrange(*size))])
        for k in (0, 100):
            text = " ".join([*(word() for _ in range(40)), *passages[p], *(word() for _ in range(40))])
            rows += [(k + p, text), (200 + k + p, text)]
    return passages, rows


def cuts(df, **options):
    return {r.doc_id: (r.n_removed_words, r.kept_by) for r in substring_dedup.substring_dedup(df, **options).collect()}


def test_passages_beside_repeated_neighbours(spark):
    passages, rows = copied()
    out = cuts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    for p, words in enumerate(passages):
        assert out[p] == (0, []) and out[200 + p][0] >= len(words)
        # a paragraph over the edge may be near (0.8), with some words of its own
        assert len(words) <= out[100 + p][0] <= len(words) + 8 and out[100 + p][1] == [p]


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    passages, rows = copied(33, 12)
    df = spark.createDataFrame([r for r in rows if r[0] < 200], "doc_id long, text string").repartition(3)
    expected = cuts(df)
    assert all(expected[100 + p][0] >= len(words) for p, words in enumerate(passages))
    full = spark.sparkContext.broadcast(np.full(1 << 24, 255, np.uint8).tobytes())
    monkeypatch.setattr(substring_dedup, "bitmap", lambda keys, key: full)
    assert cuts(df) == expected


def test_extension_goes_on(spark):
    _, rows = copied(35, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS id", "xxhash64(text) AS h", "text")
    found = [{r.id: substring_dedup.cut_out("x " * 300, r.spans, 1)[1] for r in substring_dedup.removals(df, around=n).collect()} for n in (2, 32)]
    assert found[0] == found[1]
