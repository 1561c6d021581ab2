"""Filling containers of fixed capacity with texts, by sum-of-squares packing.

Texts are measured in tokens of a public tokenizer. A text larger than a
container fills whole containers with all but its last piece; what remains is
an item. The items of a shard are placed one after another: an item goes where
it makes the sum of the squared counts of partially filled containers by fill
level least. The counts are an array by level, so a placement is one vectorised
step over the levels that are open, whatever the number of containers.

Shards are cut by a hash of the id into `shard_tokens` tokens each, so that
they are packed in parallel and alike at every cluster size; only the last
containers of a shard are less than full, a loss of at most a few containers in
thousands. Container numbers are made dense by the shards' counts.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.session import durable

SHARD_TOKENS = 4_000_000
#: Distinct capacities are taken to the driver up to this many.
MOST_CAPACITIES = 1_000


#: The usual split pattern of a byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load_tokenizer(path: str, pattern: str = PATTERN):
    """A tiktoken encoding from a file of ranks, which every executor must be able to read."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    def count(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return count


def token_counts(documents: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each id with a text that has tokens; of several rows of an id the longest counts."""
    rows = documents.where(F.col(doc_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_counter(tokenizer), f"doc_id {kind}, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


class SumOfSquares:
    """Online packing: counts[h] containers are filled to level h (0 < h < capacity)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """The container of an item of 1 to capacity tokens."""
        counts, capacity = self.counts, self.capacity
        # Moving a container from level h to h + size changes the sum by -2 counts[h] + 1, and by 2 counts[h + size] + 1 unless it is then full.
        levels = np.flatnonzero(counts[: capacity - size + 1])
        best, gain = 0, 2 * counts[size] + 1 if size < capacity else 0
        if len(levels):
            after = levels + size
            change = np.where(after < capacity, 2 * counts[after] + 1, 0) - 2 * counts[levels] + 1
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= gain:
                best = int(levels[k])
        if best:
            number = self.open[best].pop()
            counts[best] -= 1
        else:
            number, self.made = self.made, self.made + 1
        if best + size < capacity:
            self.open[best + size].append(number)
            counts[best + size] += 1
        return number


def pack(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Rows (container, doc_id, piece, n_tokens) of a shard, in the order given."""
    packer = SumOfSquares(capacity)
    containers, owners, pieces, tokens = [], [], [], []
    for i, size in zip(ids.tolist(), sizes.tolist()):
        piece = 0
        while size > capacity:
            containers.append(packer.made)
            packer.made += 1
            owners.append(i)
            pieces.append(piece)
            tokens.append(capacity)
            size -= capacity
            piece += 1
        containers.append(packer.place(size))
        owners.append(i)
        pieces.append(piece)
        tokens.append(size)
    return pd.DataFrame({"container": containers, "doc_id": owners, "piece": pieces, "n_tokens": tokens})


def _pack_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["_order", "doc_id"])
    packed = pack(group["doc_id"].to_numpy(), group["n_tokens"].to_numpy(), int(key[0]))
    return packed.assign(capacity_tokens=np.int32(key[0]), shard=np.int64(key[1]))[["capacity_tokens", "shard", "container", "doc_id", "piece", "n_tokens"]]


def packed(documents: DataFrame, budgets: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text", capacity_col: str = "capacity_tokens", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """capacity_tokens, container, doc_id, piece, n_tokens for every distinct positive capacity.

    Each text lies whole in one container unless it is larger than one; then
    its pieces 0, 1, … fill whole containers but for the last. Null and empty
    texts and null ids take no room and give no row. The budgets are a small
    table of capacities; null and non-positive ones are left out.
    """
    counts = durable(token_counts(documents, tokenizer, doc_col, text_col))
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    capacities = budgets.where(F.col(capacity_col) > 0).select(F.col(capacity_col).cast("int").alias("capacity_tokens")).distinct()
    order = F.xxhash64("doc_id")
    items = counts.where("n_tokens > 0").withColumn("_order", order).withColumn("shard", F.pmod(F.shiftright(order, 20), F.lit(shards)))
    sized = [r[0] for r in capacities.limit(MOST_CAPACITIES + 1).collect()]
    if len(sized) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    items = items.withColumn("capacity_tokens", F.explode(F.array(*[F.lit(c) for c in sized]) if sized else F.array().cast("array<int>")))
    kind = dict(counts.dtypes)["doc_id"]
    local = durable(
        items.groupBy("capacity_tokens", "shard").applyInPandas(_pack_shard, f"capacity_tokens int, shard long, container long, doc_id {kind}, piece int, n_tokens long")
    )
    made = local.groupBy("capacity_tokens", "shard").agg((F.max("container") + 1).alias("_made"))
    before = Window.partitionBy("capacity_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.withColumn("_offset", F.coalesce(F.sum("_made").over(before), F.lit(0))).drop("_made")
    return local.join(offsets, ["capacity_tokens", "shard"]).select("capacity_tokens", (F.col("container") + F.col("_offset")).alias("container"), "doc_id", "piece", "n_tokens")


def waste(rows: DataFrame) -> DataFrame:
    """capacity_tokens, n_containers, n_tokens, fill: the share of all room that is used."""
    whole = rows.groupBy("capacity_tokens").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return whole.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
