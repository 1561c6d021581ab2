"""Sum-of-squares packing."""

from __future__ import annotations

import os

import numpy as np
import pytest

from corpuskiln.llm import packing as P
from corpuskiln.llm.queries import TOKENIZER


@pytest.mark.parametrize("seed, capacity", [(1, 64), (2, 256), (3, 7)])
def test_each_item_is_whole_and_containers_hold(seed, capacity):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 3 * capacity, 800)
    rows = P.pack(np.arange(800), sizes, capacity)
    filled = rows.groupby("container").n_tokens.sum()
    assert filled.max() <= capacity and sorted(filled.index) == list(range(len(filled)))
    assert (rows.groupby("doc_id").n_tokens.sum().to_numpy() == sizes).all()
    pieces = rows.groupby("doc_id").piece.max().to_numpy() + 1
    assert (pieces == -(-sizes // capacity)).all()
    assert (rows[rows.n_tokens < capacity].groupby("doc_id").size() <= 1).all()
    assert sizes.sum() / (len(filled) * capacity) > (0.95 if capacity > 7 else 0.9)


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(4)
    packer = P.SumOfSquares(12)
    for size in rng.integers(1, 13, 300):
        before = packer.counts.copy()
        options = []
        for level in [0, *np.flatnonzero(before[: 12 - size + 1])]:
            after = before.copy()
            after[level] -= level > 0
            if level + size < 12:
                after[level + size] += 1
            options.append(int((after**2).sum()))
        packer.place(int(size))
        assert int((packer.counts**2).sum()) == min(options)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_tables(spark):
    tokenizer = P.load_tokenizer(TOKENIZER)
    texts = {1: "a few words", 2: "x " * 900, 3: "", 4: None, 5: "one more <|endoftext|> text", 6: "a few words"}
    rows = [(i, t, 7) for i, t in texts.items()] + [(1, "a few words", 7), (None, "lost", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container int")
    budgets = spark.createDataFrame([(1, 64), (2, 512), (3, None), (4, 0), (5, 64)], "budget_id int, capacity_tokens int")
    got = P.packed(docs, budgets, TOKENIZER, shard_tokens=400).collect()
    for capacity in (64, 512):
        mine = [r for r in got if r["capacity_tokens"] == capacity]
        assert {d: sum(r["n_tokens"] for r in mine if r["doc_id"] == d) for d in (1, 2, 5, 6)} == {d: len(tokenizer.encode_ordinary(texts[d])) for d in (1, 2, 5, 6)}
        numbers = {r["container"] for r in mine}
        assert numbers == set(range(len(numbers))) and {r["doc_id"] for r in mine} == {1, 2, 5, 6}
        for c in numbers:
            assert sum(r["n_tokens"] for r in mine if r["container"] == c) <= capacity
    assert P.packed(docs.where("false"), budgets, TOKENIZER).count() == 0 and P.packed(docs, budgets.where("false"), TOKENIZER).count() == 0
