"""Held-out passages inside training texts, found by an FM-index per shard.

Every run of `length` consecutive words of a held-out field is a phrase. A
shard is an Arrow batch of documents. Its words are numbered by the phrases'
vocabulary; a word outside it ends any match, so only runs of at least
`length` known words are indexed, which loses nothing. The index of a shard is
the Burrows-Wheeler transform of these runs in a wavelet matrix with sampled
suffix positions. All phrases are searched backward at once, one symbol a
step; each occurrence is located by walking back to a sampled position; and
the occurrences of a document are merged into removal spans.

The phrases are broadcast in blocks of a checked number of held-out rows, so a
larger set takes more passes over the documents and no larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.words import split_words

#: Held-out rows whose phrases are broadcast together.
BLOCK = 4_000
#: One in so many suffix positions is kept.
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    reach = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = fresh
        if rank.max() == n - 1 or reach >= n:
            return order
        reach *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol[k] occurs before position end[k]."""
        start = np.zeros_like(end)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = before[start], before[end]
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            a = before[at]
            one = (before[at + 1] - a).astype(bool)
            value |= one.astype(value.dtype) << bit
            at = np.where(one, zeros + a, at - a)
        return value


class FMIndex:
    """Backward search over a sequence of symbols 1..top in which 0 separates.

    Inside, all symbols are one greater, as the end needs a symbol of its own:
    walking back is only right if the least suffix begins with a unique one.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        symbols, top = np.r_[symbols + 1, 0].astype(np.int64), top + 1
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        self.tree = WaveletMatrix(bwt, max(1, int(top).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=top + 1))]
        kept = order % SAMPLE == 0
        self.kept_before = np.r_[0, np.cumsum(kept)]
        self.kept, self.samples = kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the suffixes that start with each row of patterns."""
        count = len(patterns)
        low, high = np.zeros(count, np.int64), np.full(count, self.first[-1], np.int64)
        live = np.arange(count)
        for step in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, step] + 1
            base = self.first[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
            gone = low[live] >= high[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to a sampled one."""
        found = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            here = self.kept[at]
            found[left[here]] = self.samples[self.kept_before[at[here]]] + steps
            left, at = left[~here], at[~here]
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return found


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def phrases(rows: list[tuple], length: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Of (item, texts...) rows: word numbers, distinct phrases, and the items of phrase k at owners[starts[k]:starts[k+1]]."""
    numbers: dict[bytes, int] = {}
    of: dict[tuple, set] = defaultdict(set)
    for item, *texts in rows:
        for words in split_words(texts):
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words] if len(words) >= length else []
            for k in range(len(ids) - length + 1):
                of[tuple(ids[k : k + length])].add(item)
    table = np.array(list(of), dtype=np.int64).reshape(len(of), length)
    starts = np.r_[0, np.cumsum([len(v) for v in of.values()])].astype(np.int64)
    return numbers, table, np.array([i for v in of.values() for i in sorted(v)], dtype=np.int64), starts


def shard_matches(texts: list[str | None], numbers: dict, table: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, phrase number) of all phrases' occurrences in a shard."""
    words = split_words(texts)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(_Numbers(numbers).__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(words)), counts)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    none = np.empty(0, np.int64)
    at = np.flatnonzero(flat)
    if not len(at) or not len(table):
        return none, none, none
    new = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] >= length
    at, run = at[keep], run[keep]
    if not len(at):
        return none, none, none
    breaks = np.flatnonzero(np.diff(run)) + 1
    symbols, source = np.insert(flat[at], breaks, 0), np.insert(at, breaks, -1)
    index = FMIndex(symbols, len(numbers))
    low, high = index.search(table)
    sizes = high - low
    which = np.repeat(np.arange(len(table)), sizes)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    word = source[index.locate(rows)]
    return owner[word], place[word], which


def _finder(shared, length: int):
    def find(batches):
        numbers, table, owners, starts = shared.value
        for batch in batches:
            doc, first, which = shard_matches(batch.column(1).to_pylist(), numbers, table, length)
            many = starts[which + 1] - starts[which]
            item = owners[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[which], many)]
            doc, first = np.repeat(doc, many), np.repeat(first, many)
            order = np.lexsort((first, item, doc))
            doc, item, first = doc[order], item[order], first[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > first[:-1] + length)] if len(doc) else np.empty(0, bool)
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(doc)] - 1 if len(head) else head
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[head])), pa.array(item[head]), pa.array(first[head].astype(np.int32)), pa.array((first[tail] + length).astype(np.int32))],
                names=["doc_id", "item_id", "first_word", "end_word"],
            )

    return find


def leaked_spans(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", fields: tuple[str, ...] = ("question", "context"), length: int = 13) -> DataFrame:
    """doc_id, item_id, first_word, end_word: merged spans (end exclusive) in which a document repeats an item.

    Words are runs of ASCII letters and digits, lower-cased; a match lies in
    one field of one item. Null texts, fields and ids give no rows, texts and
    fields of fewer than `length` words neither; repeated document rows give
    repeated spans once. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc_col]
    schema = f"doc_id {kind}, item_id long, first_word int, end_word int"
    docs = documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_text"))
    held = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("_item"), *[F.col(f) for f in fields])
    blocks = max(1, -(-held.count() // BLOCK))
    parts = []
    for b in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(phrases([tuple(r) for r in rows], length))
        parts.append(docs.mapInArrow(_finder(shared, length), schema))
    return reduce(DataFrame.unionByName, parts).distinct()


def leaks(*args, **kwargs) -> DataFrame:
    """item_id, doc_id of every leak (see leaked_spans)."""
    return leaked_spans(*args, **kwargs).select("item_id", "doc_id").distinct()
