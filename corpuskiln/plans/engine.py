"""A saved build, opened for retrieval."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln import storage
from corpuskiln.operators import retrieval, vectors


class Engine:
    """The tables of a build (see plans.pipeline) and batches of queries(query_id, text) over them."""

    TABLES = ("chunks", "vectors", "nodes", "edges", "members", "communities")

    def __init__(self, spark: SparkSession, folder: str, embed: Callable):
        self.spark, self.folder, self.embed = spark, folder, embed
        self.manifest = json.loads(storage.read_text(spark, f"{folder}/build_manifest.json") or "{}")
        for name in self.TABLES:
            setattr(self, name, spark.read.parquet(f"{folder}/{name}.parquet"))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, embed: Callable | None = None) -> Engine:
        """`embed` must be the function that the build's vectors were made with."""
        missing = [n for n in cls.TABLES if not storage.exists(spark, f"{folder}/{n}.parquet/_SUCCESS")]
        if missing:
            raise FileNotFoundError(f"no finished build in {folder}: {', '.join(missing)}")
        return cls(spark, folder, embed or vectors.hashing_embedder())

    def vector_hits(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, section_id, vector_score of the k best rows of either vector of each query."""
        asked = vectors.embedded(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")), "text", "query_vector", self.embed)
        best = vectors.dual_top_k(self.vectors, asked, k, item="chunk_ord")
        return best.join(self.vectors.select(F.col("chunk_ord").alias("item"), "section_id"), "item").select("query_id", "section_id", F.col("score").alias("vector_score"))

    def retrieve(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, depth: int = 2) -> DataFrame:
        """The k best hits of each query in one mode, with titles and snippets."""
        v = self.vector_hits(queries, k)
        g = retrieval.graph_hits(queries, self.nodes, self.edges, depth, self.communities)
        hits = retrieval.retrieve(mode, queries, v, g, k)
        shown = self.nodes.select("section_id", "title", "source", "snippet").unionByName(g.where("hop < 0").select("section_id", "title", "source", "snippet").distinct())
        return hits.join(shown, "section_id", "left")

    def community_of(self, sections: DataFrame) -> DataFrame:
        """section_id, community_id, size, summary of some sections."""
        return sections.select("section_id").distinct().join(self.members, "section_id").join(self.communities.select("community_id", "size", "summary"), "community_id")
