"""Leaks against brute force, and the FM-index itself."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpuskiln.functions.words import split_words
from corpuskiln.llm import leakage as L


@pytest.mark.parametrize("seed, letters, zeros", [(0, 3, 0.0), (1, 2, 0.1), (2, 9, 0.3)])
def test_index_finds_and_locates_every_pattern(seed, letters, zeros):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, letters + 1, 600)
    s[rng.random(600) < zeros] = 0
    index = L.FMIndex(s, letters)
    patterns = np.vstack([rng.integers(1, letters + 1, (80, 4)), [s[i : i + 4] for i in range(0, 590, 7) if (s[i : i + 4] > 0).all()]])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(597) if (s[i : i + 4] == p).all()]


def brute(docs, items, length):
    windows = lambda t: {tuple(w[k : k + length]) for w in split_words([t]) for k in range(len(w) - length + 1)}
    held = {(i, w) for i, *ts in items for t in ts for w in windows(t)}
    return {(i, d) for d, t in docs for w in windows(t) for i, x in held if x == w}


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((3, 5, 9, 20)))), " ".join(r.choices(vocabulary, k=40)) if i % 3 else None) for i in range(20)]
    docs = []
    for d in range(60):
        w = r.choices(vocabulary + ["other"], k=50)
        if d % 2:
            source = r.choice([t for _, *ts in items for t in ts if t]).split()
            at = r.randrange(max(1, len(source) - 6))
            w[20:20] = source[at : at + r.choice((4, 5, 6, 8))]
        docs.append((d, "; ".join(w).upper() if d % 3 else " ".join(w)))
    docs += [(61, None), (62, ""), (63, "v1 " * 20_000), (1, docs[1][1]), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).repartition(3)
    held = spark.createDataFrame([*items, (None, "v1 v2 v3 v4 v5", None), (99, None, None)], "item_id long, question string, context string")
    got = [tuple(x) for x in L.leaks(df, held, length=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([d for d in docs if d[0] is not None], items, 5)
    old = L.BLOCK
    try:
        L.BLOCK = 4  # the held-out set in several passes
        assert {tuple(x) for x in L.leaks(df, held, length=5).collect()} == set(got)
    finally:
        L.BLOCK = old
    assert L.leaks(df.where("false"), held).count() == 0 and L.leaks(df, held.where("false")).count() == 0


def test_spans_are_merged(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"start {text} middle {' '.join(f'w{i}' for i in range(5, 12))}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text, None)], "item_id long, question string, context string")
    assert [tuple(r)[1:] for r in L.leaked_spans(docs, items, length=6).orderBy("first_word").collect()] == [(7, 1, 31), (7, 32, 39)]
