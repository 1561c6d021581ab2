"""Vector columns: embedding, exact top-k search in one or two indexes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast together; a larger query set takes more passes.
BLOCK = 2_000


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a sentence model: signed word hashes, summed and normalised. Not comparable in quality."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimension), np.float64)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, (h >> 1) % dimension] += 1.0 if h & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

    return embed


def embedded(df: DataFrame, text_col: str, into: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Add a unit vector of each text, in Arrow batches; `embed` is loaded once a worker. Null texts embed like ''."""
    names = [*df.columns, into]
    position = names.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{into}` array<float>"

    def work(batches):
        for batch in batches:
            vectors = embed([t or "" for t in batch.column(position).to_pylist()])
            flat = pa.array(np.ascontiguousarray(vectors, np.float32).reshape(-1))
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=names)

    return df.mapInArrow(work, schema)


def _local_top(shared, k: int):
    def work(batches):
        names, queries = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            width = queries.shape[1]
            rows = np.asarray(vectors.flatten()).astype(np.float64).reshape(-1, width)
            scores = queries @ rows.T
            if best:
                keys, scores = np.concatenate([best[0][0], np.broadcast_to(keys, scores.shape)], axis=1), np.concatenate([best[0][1], scores], axis=1)
            else:
                keys = np.broadcast_to(keys, scores.shape)
            kept = np.lexsort((keys, -scores), axis=1)[:, :k]
            best = [(np.take_along_axis(keys, kept, axis=1), np.take_along_axis(scores, kept, axis=1))]
        if best:
            keys, scores = best[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, keys.shape[1])), pa.array(keys.reshape(-1)), pa.array(scores.reshape(-1))], names=["query_id", "item", "score"])

    return work


def top_k(items: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """query_id, item, score, rank: the k items with the greatest inner product (then least item) for each query.

    Exact: every partition keeps its own k best by one matrix product an Arrow
    batch, and only those are shuffled. Keys are integers; null vectors are
    left out. With fewer than k items there are fewer rows.
    """
    spark = items.sparkSession
    rows = items.where(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<float>").alias("_v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        names = np.array([r["q"] for r in block], dtype=np.int64)
        vectors = np.array([r["v"] for r in block], dtype=np.float64).reshape(len(block), -1)
        part = rows.mapInArrow(_local_top(spark.sparkContext.broadcast((names, vectors)), k), "query_id long, item long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dual_top_k(items: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", content: str = "content_vec", name: str = "name_vec") -> DataFrame:
    """query_id, item, score of the k best of either index, at most 2k a query, each with its greater score.

    An item met in the second index alone counts at least 0.
    """
    a = top_k(items, queries, k, item, content).select("query_id", "item", "score")
    b = top_k(items, queries, k, item, name).select("query_id", "item", F.greatest("score", F.lit(0.0)).alias("score"))
    return a.unionByName(b).groupBy("query_id", "item").agg(F.max("score").alias("score"))
