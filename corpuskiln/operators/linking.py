"""Coverage links between sources and statute sections: curated, inferred from references, and a fallback.

Coverage never replaces a link that is there, so curated and inferred links are
independent sets; only the fallback reads their result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions.refs import usc_root
from corpuskiln.functions.text import topic_words

STATUTE = "usc26"
PER_SOURCE, PER_PAIR, SECTIONS_PER_SOURCE, SUPPORT, PAIR_SUPPORT = 3, 2, 8, 2, 2
#: Sections that stand in where no section shares a word with a source (fixed values).
PREFERRED = ("26 USC §61", "26 USC §63", "26 USC §1")


def representatives(nodes: DataFrame, k: int) -> DataFrame:
    """source, section_id of the k nodes of each source with the shortest title, then id."""
    order = Window.partitionBy("source").orderBy(F.length("title"), F.length("section_id"), "section_id")
    return nodes.where("source <> ''").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).select("source", "section_id", "_rank")


def section_roots(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """section, root: the node that is the section itself, else the shortest statute node below it."""
    below = nodes.select("section_id", "node_ord", F.coalesce(F.when(F.col("source") == STATUTE, usc_root("section_id")), F.col("section_id")).alias("section"))
    itself = nodes.select("section_id", "node_ord", F.col("section_id").alias("section"))
    order = Window.partitionBy("section").orderBy((F.col("section_id") != F.col("section")).cast("int"), F.length("section_id"), "node_ord")
    found = below.union(itself).distinct().join(sections.select("section").distinct(), "section", "left_semi")
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("section", F.col("section_id").alias("root"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def curated_coverage(nodes: DataFrame, curated: DataFrame) -> DataFrame:
    """src, dst from curated(section, source): the section's root and the three nodes of the source with most topic words in common, both ways."""
    roots = section_roots(nodes, curated)
    titles = nodes.select(F.col("section_id").alias("root"), F.col("title").alias("_title"))
    wanted = curated.join(roots, "section").join(titles, "root").withColumn("_words", topic_words(F.concat_ws(" ", "section", "_title")))
    candidates = nodes.select("source", "section_id", "node_ord", topic_words(F.concat_ws(" ", "title", "snippet")).alias("_own"))
    order = Window.partitionBy("section", "source").orderBy(F.desc("_overlap"), "node_ord", "section_id")
    ranked = wanted.join(candidates, "source").withColumn("_overlap", F.size(F.array_intersect("_words", "_own"))).withColumn("_rank", F.row_number().over(order))
    return _both_ways(ranked.where(F.col("_rank") <= PER_SOURCE).select(F.col("root").alias("src"), F.col("section_id").alias("dst")))


def curated_cross_source(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst from curated pairs(source_a, source_b): the representatives of a with those of b, one way."""
    return _represent(nodes, pairs, PER_SOURCE)


def _represent(nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    reps = representatives(nodes, k)
    a = reps.select(F.col("source").alias("source_a"), F.col("section_id").alias("src"))
    b = reps.select(F.col("source").alias("source_b"), F.col("section_id").alias("dst"))
    return pairs.join(a, "source_a").join(b, "source_b").where("src <> dst").select("src", "dst")


def reference_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The xref edges with the sources of both ends."""
    of = nodes.select("section_id", "source")
    src, dst = of.select(F.col("section_id").alias("src"), F.col("source").alias("src_source")), of.select(F.col("section_id").alias("dst"), F.col("source").alias("dst_source"))
    return edges.where("type = 'xref'").join(src, "src").join(dst, "dst")


def inferred_sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, section, support: per source the sections it refers to at least twice (at most eight), or else its two most frequent."""
    counted = (
        reference_sources(nodes, edges)
        .where((F.col("src_source") != "") & (F.col("src_source") != STATUTE) & (F.col("dst_source") == STATUTE))
        .select(F.col("src_source").alias("source"), usc_root("dst").alias("section"))
        .where("section is not null")
        .groupBy("source", "section")
        .agg(F.count("*").alias("support"))
    )
    inside = Window.partitionBy("source")
    ranked = counted.withColumn("_most", F.max("support").over(inside)).withColumn("_rank", F.row_number().over(inside.orderBy(F.desc("support"), "section")))
    strong = (F.col("support") >= SUPPORT) & (F.col("_rank") <= SECTIONS_PER_SOURCE)
    weak = (F.col("_most") < SUPPORT) & (F.col("_rank") <= min(2, SECTIONS_PER_SOURCE))
    return ranked.where(strong | weak).select("source", "section", "support")


def inferred_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sections = inferred_sections(nodes, edges)
    reps = representatives(nodes, PER_SOURCE)
    linked = sections.join(section_roots(nodes, sections), "section").join(reps, "source")
    return _both_ways(linked.select(F.col("root").alias("src"), F.col("section_id").alias("dst")).distinct())


def inferred_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_a, source_b, support of sources (not the statute) with two or more references from a to b."""
    between = reference_sources(nodes, edges).where(
        (F.col("src_source") != "") & (F.col("dst_source") != "") & (F.col("src_source") != STATUTE) & (F.col("dst_source") != STATUTE) & (F.col("src_source") != F.col("dst_source"))
    )
    return between.groupBy(F.col("src_source").alias("source_a"), F.col("dst_source").alias("source_b")).agg(F.count("*").alias("support")).where(F.col("support") >= PAIR_SUPPORT)


def inferred_cross_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _represent(nodes, inferred_pairs(nodes, edges), PER_PAIR)


def with_coverage(edges: DataFrame, *added: DataFrame) -> DataFrame:
    """The edges and those of `added` that are new, as coverage."""
    whole = added[0]
    for more in added[1:]:
        whole = whole.unionByName(more)
    new = whole.where("src <> dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.unionByName(new.withColumn("type", F.lit("coverage")))


def incident_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, n_links: xref and coverage links at the nodes of each source; one inside a source counts at both ends."""
    kept = edges.where("type in ('xref', 'coverage')")
    ends = kept.select(F.col("src").alias("section_id")).unionAll(kept.select("dst")).groupBy("section_id").agg(F.count("*").alias("n"))
    return nodes.join(ends, "section_id", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))


def fallback_coverage(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """src, dst for sources with fewer than `least` links: the statute root with most words in common (else a preferred one) and two representatives."""
    poor = incident_counts(nodes, edges).where((F.col("source") != "") & (F.col("source") != STATUTE) & (F.col("n_links") < least)).select("source")
    roots = nodes.where((F.col("source") == STATUTE) & F.col("section_id").rlike(r"^26 USC §[0-9]+[A-Z]?$"))
    reps = representatives(nodes, PER_SOURCE).join(poor, "source", "left_semi")
    words = reps.join(nodes.select("section_id", "title", "snippet"), "section_id").select("source", F.explode(topic_words(F.concat_ws(" ", "title", "snippet"))).alias("word")).distinct()
    of_roots = roots.select(F.col("section_id").alias("root"), "node_ord", F.explode(topic_words(F.concat_ws(" ", "section_id", "title"))).alias("word"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), F.length("root"), "node_ord")
    best = words.join(of_roots, "word").groupBy("source", "root", "node_ord").agg(F.count("*").alias("n")).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("source", "root")
    rank = F.coalesce(*[F.when(F.col("section_id") == p, F.lit(i)) for i, p in enumerate(PREFERRED)], F.lit(len(PREFERRED)))
    spare = roots.orderBy(rank, F.length("section_id"), "node_ord").limit(1).select(F.col("section_id").alias("_spare"))
    chosen = poor.join(best, "source", "left").join(F.broadcast(spare)).select("source", F.coalesce("root", "_spare").alias("src"))
    return _both_ways(chosen.join(reps.where("_rank <= 2"), "source").select("src", F.col("section_id").alias("dst")))
