"""Near duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corpuskiln.functions.words import split_words
from corpuskiln.llm import near_duplicates as N


def brute(texts: dict, size: int, tenths: int) -> set:
    sets = {}
    for i, t in texts.items():
        w = split_words([t])[0]
        if len(w) >= size:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= tenths * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def corpus(seed: int, n: int = 120) -> dict:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice((3, 4, 5, 8, 12, 20, 60, 150)))] for _ in range(n // 4)]
    texts = {}
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 1 + len(w) // 12)):
            k = r.randrange(len(w))
            kind = r.random()
            if kind < 0.4:
                w[k] = r.choice(words)
            elif kind < 0.7 and len(w) > 3:
                del w[k]
            else:
                w.insert(k, r.choice(words))
        if r.random() < 0.2 and len(w) > 10:
            half = len(w) // 2
            w = w[half:] + w[:half]
        texts[f"d{i:04d}"] = " ".join(w).title() if r.random() < 0.3 else ", ".join(w)
    return texts


@pytest.mark.parametrize("seed, size, tenths", [(1, 3, 7), (2, 5, 8), (3, 3, 9)])
def test_pairs_equal_brute_force(spark, seed, size, tenths):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    got = [tuple(r) for r in N.similar_pairs(df, size=size, tenths=tenths, anchors=None).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, size, tenths)
    assert set(got) == {tuple(r) for r in N.similar_pairs(df, size=size, tenths=tenths).collect()}


def test_hot_variants_take_the_exact_path(spark):
    texts = corpus(4, 60)
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    links, members = N.linked_texts(df, size=3, tenths=7, hot=2)
    keys = {r["_id"]: r["key"] for r in members.collect()}
    found = {tuple(sorted((r["key_a"], r["key_b"]))) for r in links.collect()}
    assert found == {tuple(sorted((keys[a], keys[b]))) for a, b in brute(texts, 3, 7) if keys[a] != keys[b]}


def test_groups_and_copies(spark):
    base = [f"w{i}" for i in range(40)]
    near = " ".join(base[:20] + ["x"] + base[20:])
    rows = [("a", " ".join(base)), ("b", " ".join(base).upper()), ("c", near), ("d", "quite another text of some seven words"), ("e", "quite another text of some seven words!"), ("f", "alone in this table with words")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: (r["group_id"], r["n_links"], r["n_copies"]) for r in N.similar_groups(df, size=3, tenths=7).collect()}
    assert got == {"a": ("a", 1, 2), "b": ("a", 1, 2), "c": ("a", 1, 1), "d": ("d", 0, 2), "e": ("d", 0, 2)}


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [("a", long, 1, 9), ("b", long + " end", 1, 9), ("a", "old text of the same id", 0, 9), (None, long, 1, 9), ("n", None, 1, 9), ("e", "", 1, 9), ("s", "one two", 1, 9), ("t", "one two", 1, 9), ("a", long, 1, 9)]
    df = spark.createDataFrame(rows, "id string, text string, v int, key int")
    assert [tuple(r) for r in N.similar_pairs(df, version_col="v", size=3, tenths=7).collect()] == [("a", "b")]
    assert N.similar_pairs(df.where("false"), size=3, tenths=7).count() == 0 and N.similar_groups(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        N.similar_pairs(df, tenths=5)


def test_sketches_bound_the_difference():
    texts = list(corpus(9).values())
    value, owner = N.ring(split_words(texts), 3, N._WordHashes())
    bits = N.sketches(value, owner, len(texts))
    sets = [set(value[owner == i].tolist()) for i in range(len(texts))]
    for i in range(0, len(texts), 7):
        for j in range(i):
            apart = sum(bin(int(a) & (2**64 - 1)).count("1") for a in (bits[i] ^ bits[j]))
            assert apart <= len(sets[i] ^ sets[j])


def test_variants_common_in_a_task_are_spread(spark):
    """A third of the rows share one boilerplate; no row of it meets in one group, and no link is lost."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    boiler = [r.choice(words) for _ in range(40)]
    texts = corpus(12, 80)
    for i in range(60):
        w = list(boiler)
        for _ in range(r.randrange(6)):
            w[r.randrange(40)] = f"name{i}x{r.randrange(3)}"
        texts[f"z{i:03d}"] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    links, members = N.linked_texts(df, size=3, tenths=7, anchors=None, local=4)
    keys = {r["_id"]: r["key"] for r in members.collect()}
    found = {tuple(sorted((r["key_a"], r["key_b"]))) for r in links.collect()}
    assert found == {tuple(sorted((keys[a], keys[b]))) for a, b in brute(texts, 3, 7) if keys[a] != keys[b]}


def test_copies_in_blocks(spark):
    members = spark.createDataFrame([(f"i{i:02d}", 1 if i < 20 else 2 if i < 23 else i) for i in range(26)], "_id string, key long")
    want = {(f"i{a:02d}", f"i{b:02d}") for lo, hi in ((0, 20), (20, 23)) for a in range(lo, hi) for b in range(a + 1, hi)}
    for most in (3, 7, 1_000):
        got = [tuple(x) for x in N.copies(members, most).collect()]
        assert len(got) == len(want) and set(got) == want


def test_equal_hashes_of_different_texts():
    words = split_words(["a b c d", "e f g h", "a b c d"])
    first = N.text_hashes(words)
    keys = N.text_keys(words, first[:1])
    assert keys[0] == keys[2] == N.text_hashes(words, 1)[0] and keys[1] == first[1]


def test_newest_text_counts_even_if_short(spark):
    rows = [("a", "one two three four", 1), ("a", "short", 2), ("b", "one two three four", 1), ("c", "one two three four", 1), ("c", None, 3)]
    df = spark.createDataFrame(rows, "id string, text string, v int")
    assert N.similar_pairs(df, version_col="v", size=3, tenths=7).count() == 0


def drafts(seed: int, n: int) -> dict:
    """n drafts of one text, most of them alike, beside other texts."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = corpus(seed, 40)
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(120)] = f"name{i}x{r.randrange(9)}"
        texts[f"z{i:03d}"] = " ".join(w)
    return texts


def test_groups_of_more_than_few_texts(spark):
    """Pairs come from a group's texts with their sketches; none is lost, and no far pair is written."""
    texts = drafts(21, 60)
    assert 60 > N.FEW and 60 < N.HOT
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    got = [tuple(r) for r in N.similar_pairs(df, size=3, tenths=7, anchors=None).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 3, 7)
    far = [(5, i, 100, *[(-1) ** i * (7919 << (8 * i))] * 4) for i in range(4)] + [(5, 9, 100, -1, -1, -1, -1), (5, 8, 100, 0, 0, 0, 0), (6, 8, 100, 0, 0, 0, 0), (6, 7, 60, 0, 0, 0, 0), (6, 6, 90, 1, 0, 0, 0)]
    columns = [list(c) for c in zip(*far)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 4]) for c in columns], names=["variant", "key", "n", "s0", "s1", "s2", "s3"]) for i in (0, 4, 8)]
    found = {p for b in N._pairer(7)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))}
    apart = lambda x, y: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x[3:], y[3:]))
    assert found == {(min(x[1], y[1]), max(x[1], y[1])) for x in far for y in far if x[0] == y[0] and x[1] < y[1] and 10 * min(x[2], y[2]) >= 7 * max(x[2], y[2]) and 17 * apart(x, y) <= 3 * (x[2] + y[2])}


def shuffled(batches: list) -> int:
    return sum(len(r) for b in batches for r in b.column(2).to_pylist())


def test_bytes_of_fingerprints_do_not_depend_on_partitions():
    """A key is written once with all forms of a fingerprint: 8 bytes a variant, where a row of the shuffle took up to 24."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(400)) for _ in range(90)) for _ in range(200)]
    batches = list(N._emitter(3, 12, np.empty(0, np.int64), 64)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])))
    variants = N.ball(*N.ring(split_words(texts), 3, N._WordHashes()), 12)
    count = sum(v.size for v, _ in variants)
    assert count > 200 * 40 and shuffled(batches) == 8 * count
    kept = sorted(((b, k, x) for batch in batches for b, k, x in zip(*(c.to_pylist() for c in batch.columns))), key=lambda x: x[0])
    keys = N.text_hashes(split_words(texts))
    v, k = N._read(kept, N._FULL, N.RUN, True)
    assert sorted(zip(v.tolist(), k.tolist())) == sorted((x, int(keys[o])) for forms, o in variants for row, o in zip(forms.tolist(), o) for x in row)
