"""Coverage audit of a citation graph, and communities."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions.text import first_sentence, topic_words
from corpuskiln.operators.components import connected_components
from corpuskiln.operators.graph import undirected
from corpuskiln.operators.linking import STATUTE, incident_counts
from corpuskiln.session import durable


def audit_sources(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """One row per source: n_nodes, n_components, external_sources, n_links, is_disconnected, has_least_links."""
    known = nodes.where("source <> ''").select("section_id", "source")
    of_a = known.select(F.col("section_id").alias("a"), "source")
    of_b = known.select(F.col("section_id").alias("b"), F.col("source").alias("other"))
    external = undirected(edges).join(of_a, "a").join(of_b, "b").where("source <> other").select("source", "other").distinct()
    outside = external.groupBy("source").agg(F.array_sort(F.collect_set("other")).alias("external_sources"))
    found = connected_components(edges.select("src", "dst"))
    placed = known.join(found.withColumnRenamed("node", "section_id"), "section_id", "left").withColumn("component", F.coalesce("component", "section_id"))
    mixed = placed.groupBy("component").agg((F.min("source") < F.max("source")).alias("_mixed"))
    shared = placed.select("source", "component").distinct().join(mixed, "component").groupBy("source").agg(F.count("*").alias("n_components"), F.max("_mixed").alias("_shares"))
    sizes = known.groupBy("source").agg(F.count("*").alias("n_nodes"))
    whole = sizes.join(shared, "source").join(outside, "source", "left").join(incident_counts(nodes, edges), "source")
    none = F.array().cast("array<string>")
    return whole.select(
        "source",
        "n_nodes",
        "n_components",
        F.coalesce("external_sources", none).alias("external_sources"),
        F.col("n_links").cast("long").alias("n_links"),
        (~F.col("_shares") | F.col("external_sources").isNull()).alias("is_disconnected"),
        (F.col("n_links") >= least).alias("has_least_links"),
    )


def audit_report(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: ok, n_nodes, n_edges, n_sources, n_disconnected, n_short_of_links."""
    totals = sources.agg(F.count("*").alias("n_sources"), F.count_if("is_disconnected").alias("n_disconnected"), F.count_if(~F.col("has_least_links")).alias("n_short_of_links"))
    n_nodes, n_edges = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    return n_nodes.join(n_edges).join(totals).select(((F.col("n_disconnected") == 0) & (F.col("n_short_of_links") == 0)).alias("ok"), "*")


class CoverageError(RuntimeError):
    """A strict audit failed."""


def require_coverage(report: DataFrame) -> None:
    row = report.first()
    if not row["ok"]:
        raise CoverageError(f"{row['n_disconnected']} sources are disconnected, {row['n_short_of_links']} have too few links")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """section_id, community_id by label propagation on the undirected graph.

    Each round half of the nodes (by hash and round) takes the label most
    frequent among its neighbours, of several the least; so labels seldom swing
    between two states for ever. After `rounds` it stops, settled or not, and warns
    if not. Ids count from 0 by size, then least member. A deterministic stand-in
    for modularity maximization.
    """
    links = durable(undirected(edges))
    labels = nodes.select(F.col("section_id").alias("a"), F.col("section_id").alias("label"))
    quiet = 0
    for r in range(rounds):
        votes = links.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        most = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("_label"))
        turn = F.pmod(F.xxhash64("a") + r, F.lit(2)) == 0
        fresh = durable(labels.join(most, "a", "left").select("a", F.when(turn | F.lit(r == 0), F.coalesce("_label", "label")).otherwise(F.col("label")).alias("label")))
        changed = fresh.withColumnRenamed("label", "_new").join(labels, "a").where("_new <> label").limit(1).count()
        labels = fresh
        quiet = 0 if changed else quiet + 1
        if quiet == 2:  # neither half moved
            break
    else:
        warnings.warn(f"communities not settled after {rounds} rounds", RuntimeWarning, stacklevel=2)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("a").alias("least"))
    ids = sizes.withColumn("community_id", F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1)
    return labels.join(ids.select("label", "community_id"), "label").select(F.col("a").alias("section_id"), "community_id")


def community_summaries(nodes: DataFrame, members: DataFrame, first: int = 20, length: int = 1500) -> DataFrame:
    """community_id, size, summary, keywords: titles, then first sentences of the first 20 members (statute first, then by id), and the titles' words of five letters or more.

    The member list is the table `members` itself; it isn't gathered into one row.
    """
    order = Window.partitionBy("community_id").orderBy((F.col("source") != STATUTE).cast("int"), "section_id")
    placed = nodes.join(members, "section_id").withColumn("_rank", F.row_number().over(order))
    sizes = placed.groupBy("community_id").agg(F.count("*").alias("size"))
    head = placed.where(F.col("_rank") <= first).select(
        "community_id",
        "_rank",
        F.when(F.col("title") != "", F.concat(F.lit("["), F.col("section_id"), F.lit("] "), F.col("title"))).alias("_line"),
        F.nullif(first_sentence("snippet"), F.lit("")).alias("_first"),
        topic_words("title", 5).alias("_words"),
    )

    def lines(column: str):
        kept = F.filter(F.array_sort(F.collect_list(F.struct("_rank", F.col(column).alias("x")))), lambda s: s["x"].isNotNull())
        return F.transform(kept, lambda s: s["x"])

    told = head.groupBy("community_id").agg(lines("_line").alias("_titles"), lines("_first").alias("_texts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_words")))).alias("keywords"))
    return sizes.join(told, "community_id").select("community_id", "size", F.substring(F.array_join(F.concat("_titles", "_texts"), " "), 1, length).alias("summary"), "keywords")
