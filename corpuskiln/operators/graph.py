"""The citation graph as two tables: nodes(section_id, node_ord, id, title, source, snippet) and edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.session import durable

SNIPPET = 300


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """One node per section_id: the attributes of its last chunk by chunk_ord, placed where its first one is."""
    last = F.max(F.struct("chunk_ord", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET).alias("snippet")))
    found = chunks.where("section_id is not null").groupBy("section_id").agg(F.min("chunk_ord").alias("node_ord"), last.alias("_last"))
    return found.select("section_id", "node_ord", "_last.id", "_last.title", "_last.source", "_last.snippet")


def prefix_index(nodes: DataFrame, k: int = 2) -> DataFrame:
    """prefix, section_id: the k shortest ids (then first) of each prefix before a colon."""
    shortest = F.row_number().over(Window.partitionBy("prefix").orderBy(F.length("section_id"), "node_ord", "section_id"))
    prefixed = nodes.where(F.col("section_id").contains(":")).withColumn("prefix", F.btrim(F.substring_index("section_id", ":", 1)))
    return prefixed.withColumn("_rank", shortest).where(F.col("_rank") <= k).select("prefix", "section_id")


def graph_edges(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, type: hierarchy from known parents, xref to known ids, else to the shortest ids of a known prefix.

    Of several links between two nodes the last by (chunk_ord, place) gives the type.
    """
    known = nodes.select(F.col("section_id").alias("_known"))
    rows = chunks.where("section_id is not null")
    above = (
        rows.where("parent_id is not null")
        .join(known, F.col("parent_id") == F.col("_known"), "left_semi")
        .select(F.col("parent_id").alias("src"), F.col("section_id").alias("dst"), F.lit("hierarchy").alias("type"), "chunk_ord", F.lit(-1).alias("place"))
    )
    refs = rows.select("section_id", "chunk_ord", F.posexplode("cross_refs").alias("place", "ref")).where("ref is not null")
    exact = refs.join(known, F.col("ref") == F.col("_known"), "left_semi").select(F.col("section_id").alias("src"), F.col("ref").alias("dst"), F.lit("xref").alias("type"), "chunk_ord", "place")
    loose = refs.join(known, F.col("ref") == F.col("_known"), "left_anti")
    targets = prefix_index(nodes).withColumnRenamed("section_id", "dst")
    by_prefix = loose.join(targets, F.col("ref") == F.col("prefix")).select(F.col("section_id").alias("src"), "dst", F.lit("xref").alias("type"), "chunk_ord", "place")
    every = above.unionByName(exact).unionByName(by_prefix)
    return every.groupBy("src", "dst").agg(F.max(F.struct("chunk_ord", "place", "type"))["type"].alias("type"))


def undirected(edges: DataFrame) -> DataFrame:
    """a, b: each edge both ways, without loops and repeats."""
    there = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return there.union(there.select("b", "a")).distinct()


def hops(edges: DataFrame, starts: DataFrame, depth: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, node, hop: the least number of links (either way) from any start(keys, node), up to `depth`.

    One join and one anti-join a level, for all queries at once.
    """
    links = undirected(edges)
    seen = durable(starts.select(*keys, "node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        following = front.select(*keys, F.col("node").alias("a")).join(links, "a").select(*keys, F.col("b").alias("node")).distinct()
        front = durable(following.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, node, hop of all nodes within `depth` links of each start node, without the start."""
    found = hops(edges, starts.select(F.col("node").alias("start"), "node"), depth, keys=("start",))
    return found.where("hop > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: in-links plus out-links; a loop counts twice."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


def top_degree_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """The edges among the n nodes of the highest degree (then least id); all edges for n = 0."""
    if n <= 0:
        return edges
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(max(1, n)).select("node")
    among = edges.join(top.select(F.col("node").alias("src")), "src", "left_semi")
    return among.join(top.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "type")
